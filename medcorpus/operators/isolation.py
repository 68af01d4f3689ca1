"""Contamination, leakage and isolation between training and evaluation data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medcorpus.functions.text import norm_key
from medcorpus.operators.blooms import Bloom, bloom_of
from medcorpus.storage import small_batches, spread, stored

WINDOW_CHARS = 20
#: Characters of normalised texts that are hashed at once: few, so that a task's arrays are small and stay in its core's cache.
CHARS_AT_ONCE = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


def windows(key: Column, chars: int = WINDOW_CHARS) -> Column:
    """Distinct windows of a normalised key. Look-ahead keeps the normaliser out of a per-window lambda."""
    return F.array_distinct(F.regexp_extract_all(key, F.lit(f"(?=(.{{{chars}}}))"), F.lit(1)))


def build_eval_index(questions: DataFrame, chars: int = WINDOW_CHARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct exact keys, distinct windows, and counts by source of questions(source, text)."""
    keyed = questions.select("source", norm_key(F.col("text")).alias("key")).filter("key <> ''")
    exact = keyed.select("key").distinct()
    return exact, exact.select(F.explode(windows(F.col("key"), chars)).alias("w")).distinct(), keyed.groupBy("source").agg(F.count("*").alias("n"))


def window_hashes(codes: np.ndarray, chars: int) -> np.ndarray:
    """A 64-bit hash of each run of chars code points: a polynomial, of which that of a run is made of those of its halves."""
    n = max(0, len(codes) - chars + 1)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    out, size, step = codes, 1, int(_STEP)
    for bit in f"{chars:b}"[1:]:
        # two runs in a row, and then one more character
        out, size = out[: len(out) - size] * np.uint64(step) + out[size:], 2 * size
        step = step * step % 2**64
        if bit == "1":
            out, size = out[: len(codes) - size] * _STEP + codes[size:], size + 1
            step = step * int(_STEP) % 2**64
    out = out ^ out >> np.uint64(32)
    return out * _STEP


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _hashed(values: DataFrame, column: str, chars: int) -> DataFrame:
    """The windows of a column as hashes: one a row, as its values are of chars characters."""

    def hashed(batches):
        for b in batches:
            own = window_hashes(_codes("".join(b.column(0).to_pylist())), chars)[::chars] if b.num_rows else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["hash"])

    return values.select(column).mapInArrow(hashed, "hash long")


def sliced(batches, rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Arrow batches in small slices, so that a task holds few texts as Python strings at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _spans(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHARS_AT_ONCE characters; a longer text is one of its own."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        if k > begin and size + len(t) > CHARS_AT_ONCE:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if texts:
        yield begin, len(texts)


def _candidates(batches, index: Bloom, exact: Bloom, chars: int) -> Iterator[pa.RecordBatch]:
    """Of texts (key, text's digest, its first bytes as a number, normalised text) the windows that may be in the index, each once a text; and a row without one if the text itself may be."""
    for b in sliced(batches):
        digests, heads, texts = b.column(1), b.column(2).to_numpy().view(np.uint64), b.column(3).to_pylist()
        whole = set(exact.where(heads).tolist())
        rows, sizes, found = [], [], []
        for begin, end in _spans(texts):
            some = texts[begin:end]
            own = window_hashes(_codes("".join(some)), chars)
            at, stops = index.where(own), np.cumsum([len(t) for t in some])
            text_of = np.searchsorted(stops, at, side="right")
            # windows over a text's end are none
            inside = at + chars <= stops[np.minimum(text_of, len(some) - 1)]
            places = dict.fromkeys(text_of[inside].tolist(), ())
            for k, p in zip(text_of[inside].tolist(), at[inside].tolist(), strict=True):
                places[k] += (p,)
            for k in sorted({*places, *(w - begin for w in whole if begin <= w < end)}):
                first = int(stops[k]) - len(some[k])
                mine = dict.fromkeys(some[k][p - first : p - first + chars] for p in places.get(k, ()))
                n = len(np.unique(own[first : max(first, int(stops[k]) - chars + 1)]))
                hits = [*mine, *([None] if k + begin in whole else [])]
                rows += [begin + k] * len(hits)
                sizes += [n] * len(hits)
                found += hits
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), digests.take(take), pa.array(sizes, pa.int64()), pa.array(found, pa.string())], names=["key", "text", "n_windows", "w"])


def contamination(texts: DataFrame, key: str, text: str, questions: DataFrame, frac: float = 0.5, chars: int = WINDOW_CHARS) -> DataFrame:
    """key, n_hits, n_windows, exact, contaminated per distinct normalised text of a key that shares anything with the questions.

    A key may have several texts (turns): each is judged by itself. The index goes to the tasks as a Bloom filter of window hashes, whatever its
    size, and is tested where the texts lie. Only windows that pass are moved and joined with the index on the string; the filter
    lets pass too many, never too few. A text's windows are counted by 64-bit hashes. Texts are the same if their SHA-256 is.
    """
    small_batches(texts.sparkSession)
    exact, index, _ = build_eval_index(questions, chars)
    index = stored(index)
    digest = F.sha2("_key", 256)
    head = lambda d: F.conv(F.substring(d, 1, 15), 16, 10).cast("long")
    exact = stored(exact.select(F.sha2("key", 256).alias("_text")))
    seen, whole = bloom_of(_hashed(index, "w", chars), "hash", index.count()), bloom_of(exact.select(head(F.col("_text")).alias("hash")), "hash", exact.count())
    # exploded, not filtered: a filter would make the key once more
    keyed = spread(texts.select(F.col(key).alias("_id"), F.col(text).alias("_raw"))).select("_id", F.explode(F.array(norm_key(F.col("_raw")))).alias("_key")).filter("_key <> ''")
    some = keyed.select("_id", digest.alias("_text"), "_key").select("_id", "_text", head(F.col("_text")).alias("_head"), "_key")
    kind = dict(texts.dtypes)[key]
    cut = stored(some.mapInArrow(lambda it: _candidates(it, seen, whole, chars), f"_id {kind}, _text string, n_windows long, w string"))
    hits = cut.filter("w is not null").join(index, "w").distinct().groupBy("_id", "_text", "n_windows").agg(F.count("*").alias("n_hits"))
    same = cut.filter("w is null").join(exact, "_text", "left_semi").select("_id", "_text", F.col("n_windows").alias("_n"), F.lit(True).alias("exact")).distinct()
    out = hits.join(same, ["_id", "_text"], "full").withColumn("n_windows", F.coalesce("n_windows", "_n")).drop("_text", "_n").na.fill({"n_hits": 0, "exact": False})
    out = out.select(F.col("_id").alias(key), "n_hits", "n_windows", "exact")
    return out.withColumn("contaminated", F.col("exact") | ((F.col("n_windows") > 0) & (F.col("n_hits") >= frac * F.col("n_windows"))))


def contaminated_keys(df: DataFrame, key: str, text: str, questions: DataFrame, frac: float = 0.5) -> DataFrame:
    """The keys with a contaminated text, each once."""
    return contamination(df, key, text, questions, frac).filter("contaminated").select(key).distinct()


def decontaminate(df: DataFrame, key: str, text: str, questions: DataFrame, frac: float = 0.5) -> DataFrame:
    """Rows whose key is not contaminated by any of its texts."""
    return df.join(contaminated_keys(df, key, text, questions, frac), key, "left_anti")


def drop_shared(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Training rows whose keys do not occur in the test rows (a pair, an entity, a subject)."""
    return train.join(test.select(*keys).distinct(), keys, "left_anti")


def leakage_report(train: DataFrame, test: DataFrame, entity: str, pair: list[str]) -> DataFrame:
    """One row: distinct entities of both sides, shared ones, duplicate pairs, and rows dropped by each rule."""
    test_pairs, test_entities = test.select(*pair).distinct(), test.select(entity).distinct()
    marked = train.join(test_pairs.withColumn("_p", F.lit(1)), pair, "left").join(test_entities.withColumn("_e", F.lit(1)), entity, "left")
    own = marked.agg(
        F.count_distinct(entity).alias("train_entities"), F.count_distinct(F.when(F.col("_e") == 1, F.col(entity))).alias("shared_entities"),
        (F.count("*") - F.count_distinct(*pair)).alias("duplicates"), F.count("_p").alias("pair_rows"), F.count("_e").alias("entity_rows"),
        F.count(F.when(F.col("_p").isNull() & (F.col("_e") == 1), 1)).alias("left_on_shared"),
    )
    # two tables of one row
    return own.join(test.agg(F.count_distinct(entity).alias("test_entities")))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one table has, with the side that misses them; none if the key sets are equal."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full").filter("_a is null or _b is null").select(key, F.when(F.col("_a").isNull(), "left").otherwise("right").alias("missing_in"))


def first_of_each(rows: DataFrame, key: str, order: str, wanted: DataFrame, fail: bool = False) -> DataFrame:
    """The first row by order of each wanted key; with fail, a wanted key without a row is an error when the result is used."""
    keys = wanted.select(key).distinct()
    rest = [c for c in rows.columns if c not in (key, order)]
    first = rows.join(keys, key, "left_semi").groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_r"))
    if fail:
        missing = F.raise_error(F.concat(F.lit(f"no row for {key} "), F.col(key).cast("string")))
        first = keys.join(first, key, "left").withColumn("_r", F.when(F.col("_r").isNull(), missing).otherwise(F.col("_r")))
    return first.select(key, "_r.*")


def restrict_to_split(df: DataFrame, split: DataFrame, key: str, half: str | None) -> DataFrame:
    """Rows of one stored half; all rows of both for None."""
    ids = split if half is None else split.filter(F.col("half") == half)
    return df.join(ids.select(key), key, "left_semi")


def split_misses(df: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """half, n, missing: ids of each stored half, and those of them that df has no row of."""
    there = df.select(key).distinct().withColumn("_there", F.lit(1))
    return split.select(key, "half").join(there, key, "left").groupBy("half").agg(F.count("*").alias("n"), F.count(F.when(F.col("_there").isNull(), 1)).alias("missing"))


def group_overlaps(train: DataFrame, test: DataFrame, group: str, entity: str) -> DataFrame:
    """train_group, test_group, shared: entities that each group of the training rows shares with each of the test rows, where there are any."""
    a, b = (x.select(F.col(group).alias(name), entity).distinct() for x, name in ((train, "train_group"), (test, "test_group")))
    return a.join(b, entity).groupBy("train_group", "test_group").agg(F.count("*").alias("shared"))


def half_overlap(split: DataFrame, key: str, half: str = "half") -> DataFrame:
    """n_shared: ids that are in more than one half of a stored split."""
    return split.groupBy(key).agg(F.count_distinct(half).alias("_n")).filter("_n > 1").agg(F.count("*").alias("n_shared"))


def isolation_matrix(train: DataFrame, test: DataFrame, group: str, entity: str) -> DataFrame:
    """group, train, test, seen_rows: distinct entities of both sides, and test rows whose entity is in the training rows."""
    both = train.select(group, entity, F.lit("train").alias("_half")).unionByName(test.select(group, entity, F.lit("test").alias("_half")))
    wide = both.groupBy(group).pivot("_half", ["train", "test"]).agg(F.count_distinct(entity)).na.fill(0)
    seen = test.join(train.select(entity).distinct(), entity, "left_semi").groupBy(group).agg(F.count("*").alias("seen_rows"))
    return wide.join(seen, group, "left").na.fill(0, ["seen_rows"])


def seen_unseen_accuracy(df: DataFrame, seen: DataFrame, entity: str, correct: Column) -> DataFrame:
    """tag, seen, n, accuracy for all items (seen null), and for those on seen and on unseen entities."""
    x = df.join(seen.select(entity).distinct().withColumn("seen", F.lit(True)), entity, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return x.groupingSets([[F.col("tag")], [F.col("tag"), F.col("seen")]], F.col("tag"), F.col("seen")).agg(F.count("*").alias("n"), F.avg(correct.cast("int")).alias("accuracy"))
