"""Exact dedup against a dictionary of texts."""

import hashlib
import random

import pytest

from medcorpus.llm.op10_exact import drop_exact_duplicates, exact_duplicates, name_texts, op10_exact_dedup


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for t, ids in groups.items():
        best = max((d for d in ids if d is not None), default=None)
        seen = False
        for d in ids:
            kept = d == best and not seen
            seen |= kept
            out.append((d, best, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_same_as_dictionary(spark, block):
    rng = random.Random(block)
    texts = ["".join(rng.choice("ab\né👍 ") for _ in range(rng.randrange(0, 14))) for _ in range(60)] + ["ab" * 5000, "ab" * 5000 + "c", "abab"]
    rows = [(k, rng.choice(texts)) for k in range(300)] + [(7, texts[0]), (400, texts[1]), (400, texts[1]), (None, texts[2]), (500, None), (501, ""), (None, "only null"), (None, "only null")]
    df = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, name string").repartition(3)
    assert sorted((tuple(r) for r in exact_duplicates(df, block_chars=block).collect()), key=str) == brute(rows)


def test_names_are_equal_where_texts_are(spark):
    texts = ["aaaa", "aaaa", "aaab", "", "", "aa", "aaaaaaaaa", "aaaaaaaaa", "aaaaaaaa"]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {r.row: (r.n_blocks, r.name) for r in name_texts(df, 2).collect()}
    assert all((got[a] == got[b]) == (texts[a] == texts[b]) for a in got for b in got) and len(got) == len(texts)


def test_dropping_keeps_columns(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (2, "a", "y"), (3, None, "z"), (None, "", "q"), (4, "b", "w")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, sha string, print long, row long, `kept.x` int")
    out = drop_exact_duplicates(df)
    assert out.columns == df.columns
    got = sorted((tuple(r)[:3] for r in out.collect()), key=str)
    assert got == [(2, "a", "y"), (3, None, "z"), (4, "b", "w")]
    assert exact_duplicates(df.limit(0)).count() == 0


def test_a_tie_of_rows_is_always_decided_alike(spark):
    rows = [(5, "same", f"c{k}") for k in range(40)] + [(4, "same", "x")]
    kept = {drop_exact_duplicates(spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, name string").repartition(n)).collect()[0].name for k, n in ((0, 1), (7, 3), (20, 5))}
    assert len(kept) == 1


def test_registered_query_with_very_long_texts(spark, tmp_path):
    rows = [(1, "long " * 300_000), (2, "long " * 300_000), (3, "long " * 299_999), (4, None), (5, "")]
    spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, keep_id long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in op10_exact_dedup(spark, str(tmp_path)).collect()), key=str) == brute(rows)
