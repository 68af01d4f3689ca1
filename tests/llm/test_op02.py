"""Quality classifier: accuracy on rows it did not see, and its parts."""

import math
import random
import zlib
from bisect import bisect_right

import numpy as np

from medcorpus.llm.op02_quality import FEATURES, THRESHOLD, AdditiveModel, fit_additive, is_held_out, op2_quality, quality_score, text_features, train_quality


def texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "of", "that", "river", "stone", "and", "light", "seven", "garden", "window"]
    out = []
    for k in range(n):
        good = [rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(15, 200))]
        kind = k % 4
        own = good if kind else [[w.upper() + "!!", w + " |", w + rng.choice(["$$$", "%%%"])][k // 4 % 3] for w in good]
        out.append((k, " ".join(own), int(kind > 0)))
    return out


def test_held_out_accuracy(spark):
    rows = texts(600, 1)
    docs = spark.createDataFrame([(k, t, 9) for k, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows if k % 3] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = train_quality(docs, labels)
    from pyspark.sql import functions as F

    got = docs.select("doc_id", quality_score(F.col("text"), model).alias("s")).collect()
    truth = {k: q for k, _, q in rows}
    assert np.mean([(r.s >= 0.7) == truth[r.doc_id] for r in got if r.doc_id % 3 == 0]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 200_000)], "doc_id long, text string")
    assert all(0 <= r[0] <= 1 for r in odd.select(quality_score(F.col("text"), model)).collect())


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = train_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert model.score(np.zeros((2, len(FEATURES)))).tolist() == [0.5, 0.5]


def test_pairs_find_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit_additive(x, y, pairs=1)
    assert model.pairs == [(0, 1)] and np.mean((model.score(x) > 0.5) == y) > 0.9


def test_features():
    assert len(text_features("")) == len(FEATURES) and text_features("a a\na a")[FEATURES.index("distinct_lines")] == 0.5
    assert AdditiveModel().score(np.zeros((1, 1)))[0] == 0.5


def by_hand(model, features):
    """The score of one text, looked up table by table."""
    total = model.intercept
    for v, edges, table in zip(features, model.edges, model.tables, strict=True):
        total += table[bisect_right(edges.tolist(), v)]
    for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
        total += table[bisect_right(model.pair_edges[a].tolist(), features[a])][bisect_right(model.pair_edges[b].tolist(), features[b])]
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def test_registered_query_against_a_plain_loop(spark, tmp_path):
    rows = texts(300, 4) + [(7, "a second text of doc seven", 1), (900, None, 1), (901, "", 1), (901, "", 1), (902, "long! " * 100_000, 0)]
    docs = spark.createDataFrame([(d, t, 1, 2.0) for d, t, _ in rows], "doc_id long, text string, predicted int, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in texts(300, 4)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert {d: is_held for d, is_held in docs.select("doc_id", is_held_out(docs.doc_id)).collect()} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, *_ in rows}
    got = sorted(tuple(r) for r in op2_quality(spark, str(tmp_path)).collect())
    model = train_quality(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels.filter(~is_held_out(labels.doc_id)))
    want = []
    for d, t, _ in rows:
        s = by_hand(model, text_features(t or ""))
        want.append((d, zlib.crc32(str(d).encode()) % 4 == 2, s, int(s >= THRESHOLD)))
    want.sort()
    assert [(d, h, p) for d, h, _, p in got] == [(d, h, p) for d, h, _, p in want]
    assert np.allclose([s for *_, s, _ in got], [s for *_, s, _ in want], atol=1e-9)
    truth = {d: q for d, _, q in texts(300, 4)}
    held = [(d, p) for d, h, _, p in got if h and d in truth]
    assert len(held) > 40 and np.mean([truth[d] == p for d, p in held]) > 0.95


def test_rows_that_are_learnt_from_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(200)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert train_quality(docs, labels, max_rows=50).intercept > 0


def test_most_frequent_word_does_not_depend_on_its_length():
    top = FEATURES.index("top_word")
    assert text_features("considerable " * 8 + "a b c d e f g h i j k l")[top] == 8 / 20
