"""Quality classifier: a generalised additive model with pairwise interactions.

Features are shares and ratios of the whole text's bytes, words and lines. Every feature is cut into bins at
quantiles; boosting goes round the features in turn and adds to each one's lookup table a shallow tree over its
bins, then does the same for the few pairs of features whose interaction explains most of what is left. A
document's score is the logistic of the intercept plus one table entry per feature and pair.

The tables are learnt on the driver from the rows of at most ``max_rows`` labelled documents, those with the smallest hash
of their id, and of these rows from at most max_rows; only their features leave the executors. Everything else is one pass
over the documents.

Cases: a null text is empty and gets a score like any other; very long texts are read whole; labels that are null do not
count, and of repeated labels of one document the largest counts; repeated rows are scored once each, and all rows of a labelled
doc_id are learnt from; texts with the same features tie; a null doc_id is not held out; other columns are never read; with no labels, or labels of one kind, the score is the smoothed share of label 1 for all; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medcorpus.llm.common import small_batches, table

FEATURES = (
    "log_words", "word_length", "distinct_words", "distinct_lines", "words_a_line", "top_word", "upper", "lower", "digits", "blanks",
    "exclamation", "bars", "stops", "symbols", "other_marks", "beyond_ascii", "entropy", "late_symbols", "late_upper", "late_distinct",
)
#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, RATE, PAIRS = 48, 8, 160, 60, 0.1, 6
THRESHOLD = 0.7
_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "blanks": (9, 10, 11, 12, 13, 32), "exclamation": (33,), "bars": (124,), "stops": (44, 46),
    "symbols": tuple(map(ord, "#$%&*@^~<>=+_\\/{}[]")), "other_marks": tuple(map(ord, "\"'()-:;?`")), "beyond_ascii": range(128, 256),
}
_TABLE = np.zeros((256, len(_GROUPS)))
for _k, _of in enumerate(_GROUPS.values()):
    _TABLE[list(_of), _k] = 1


def text_features(text: str) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = max(1, len(data))
    counts = np.bincount(data, minlength=256)
    shares = counts @ _TABLE / n
    words, lines = text.split(), text.split("\n")
    k = len(words)
    p = counts[counts > 0] / n
    late = np.bincount(data[len(data) // 2 :], minlength=256) @ _TABLE / max(1, len(data) - len(data) // 2)
    half = words[k // 2 :]
    distinct = set(words)
    top = max(Counter(words).values(), default=0)
    own = {"upper": shares[0], **dict(zip(_GROUPS, shares, strict=True))}
    own |= {
        "log_words": np.log1p(k), "word_length": sum(map(len, words)) / max(1, k), "distinct_words": len(distinct) / max(1, k), "distinct_lines": len(set(lines)) / len(lines),
        "words_a_line": k / len(lines), "top_word": top / max(1, k), "entropy": float(-(p * np.log2(p)).sum()) if len(data) else 0.0,
        "late_symbols": late[list(_GROUPS).index("symbols")], "late_upper": late[0], "late_distinct": len(set(half)) / max(1, len(half)),
    }
    return [float(own[name]) for name in FEATURES]


@dataclass
class AdditiveModel:
    """Bin edges, a table per feature, and a table per pair of features over coarser bins."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, own) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += own[np.searchsorted(edges, x[:, k], side="right")]
        for (a, b), own in zip(self.pairs, self.pair_tables, strict=True):
            total += own[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of each bin, of the tree that splits a range of bins where the gain is largest."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, left: int) -> None:
        gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        if left and b - a > 1:
            gain = _gain(gs[:-1], hs[:-1]) + _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1])
            k = int(np.argmax(gain))
            if gain[k] > _gain(gs[-1:], hs[-1:])[0] + 1e-9:
                grow(a, a + k + 1, left - 1)
                grow(a + k + 1, b, left - 1)
                return
        out[a:b] = gs[-1] / (hs[-1] + 1.0)

    grow(0, len(g), depth)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the cells of the tree with one cut on each axis, and its gain over none."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    n, m = g.shape
    best, value = 0.0, np.zeros_like(g)
    for i in range(n - 1):
        for j in range(m - 1):
            parts_g = np.array([gs[i, j], gs[i, -1] - gs[i, j], gs[-1, j] - gs[i, j], gs[-1, -1] - gs[i, -1] - gs[-1, j] + gs[i, j]])
            parts_h = np.array([hs[i, j], hs[i, -1] - hs[i, j], hs[-1, j] - hs[i, j], hs[-1, -1] - hs[i, -1] - hs[-1, j] + hs[i, j]])
            gain = float(_gain(parts_g, parts_h).sum() - _gain(gs[-1, -1], hs[-1, -1]))
            if gain > best:
                v = parts_g / (parts_h + 1.0)
                best, value = gain, np.block([[np.full((i + 1, j + 1), v[0]), np.full((i + 1, m - j - 1), v[1])], [np.full((n - i - 1, j + 1), v[2]), np.full((n - i - 1, m - j - 1), v[3])]])
    return value, best


def fit_additive(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS) -> AdditiveModel:
    """The model of features x for labels y (0 or 1)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(intercept=float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    cuts = lambda v, n: np.unique(np.quantile(v, np.arange(1, n) / n))
    d = x.shape[1]
    model.edges = [cuts(x[:, k], BINS) for k in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)
    slopes = lambda: (y - (p := 1 / (1 + np.exp(-total))), p * (1 - p))
    for _ in range(ROUNDS):
        for k in range(d):
            g, h = slopes()
            n = len(model.tables[k])
            step = RATE * _shallow_tree(np.bincount(bins[k], g, n), np.bincount(bins[k], h, n))
            model.tables[k] += step
            total += step[bins[k]]
    model.pair_edges = [cuts(x[:, k], PAIR_BINS) for k in range(d)]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.pair_edges)]
    shape = lambda a, b: (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)

    def cells(a: int, b: int, v: np.ndarray) -> np.ndarray:
        n, m = shape(a, b)
        return np.bincount(coarse[a] * m + coarse[b], v, n * m).reshape(n, m)

    g, h = slopes()
    gains = sorted(((-_quadrants(cells(a, b, g), cells(a, b, h))[1], a, b) for a in range(d) for b in range(a + 1, d)))
    model.pairs = [(a, b) for gain, a, b in gains[:pairs] if gain < 0]
    model.pair_tables = [np.zeros(shape(a, b)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _quadrants(cells(a, b, g), cells(a, b, h))[0]
            model.pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return model


def _features_of(texts: pd.Series) -> np.ndarray:
    return np.array([text_features(t or "") for t in texts], dtype=float).reshape(len(texts), len(FEATURES))


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """The model learnt from labels(doc_id, quality) of docs."""
    small_batches(docs.sparkSession)
    own = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def features(batches):
        for b in batches:
            f = _features_of(b["text"])
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], **{name: f[:, k] for k, name in enumerate(FEATURES)}})

    # at most max_rows ids and labels are broadcast
    joined = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    schema = "doc_id long, quality int, " + ", ".join(f"{n} double" for n in FEATURES)
    # of a doc_id that many rows share as many are kept as of any other, up to max_rows in all
    order = [F.xxhash64("doc_id", *FEATURES), F.col("doc_id"), *map(F.col, FEATURES)]
    rows = joined.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text").mapInPandas(features, schema).orderBy(*order).limit(max_rows).toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES])
    return fit_additive(rows[list(FEATURES)].to_numpy(dtype=float), rows["quality"].to_numpy(dtype=float))


def quality_score(text: Column, model: AdditiveModel) -> Column:
    """The score of a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_features_of(texts)), index=texts.index)

    return score(text)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, table(spark, sf_dir, "labels").filter(~is_held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
ORACLE_SQL: dict[str, str] = {}
