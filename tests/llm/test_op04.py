"""Repeated windows against a plain search."""

import hashlib
import random
import re

import numpy as np
import pytest

from medcorpus.llm.op04_substrings import drop_repeats, nodes, op4_substring_dedup, sorted_suffixes


def brute(rows):
    find = re.compile(r"[^\x20\x09-\x0D]+").findall
    words = [(d, find(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for k in range(len(w) - 12):
            if d is not None:
                s = tuple(w[k : k + 13])
                first[s] = min(first.get(s, d), d)
    out = []
    for d, w in words:
        gone = {k + i for k in range(len(w) - 12) if d is not None and first[tuple(w[k : k + 13])] < d for i in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("group_rows", [400_000, 3])
def test_same_as_plain_search(spark, group_rows):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(30)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 40))] for _ in range(12)] + [["ha"] * 30]
    rows = []
    for d in range(120):
        text = []
        for _ in range(rng.randrange(0, 6)):
            text += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))]
        rows.append((d, " ".join(text)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (5, rows[7][1]), (5, rows[40][1]), (3, rows[3][1]), (300, None), (301, ""), (None, rows[3][1]), (302, "é\n" * 40), (303, "é " * 14)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, h int").repartition(3)
    assert sorted((tuple(r) for r in drop_repeats(df, group_rows=group_rows).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_nodes_are_those_of_a_suffix_tree():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 3, (300, 7)).astype(np.uint32)
    group = np.sort(rng.integers(0, 4, 300))
    order, common = sorted_suffixes(group, words)
    rows = [(group[k], *words[k]) for k in order]
    assert rows == sorted(rows)
    for depth in range(8):
        # inserting the suffixes word by word, the rows below one node of this depth are those with one path to it
        path = {}
        want = [path.setdefault((group[k], *words[k][:depth]), len(path)) for k in range(300)]
        got = nodes(order, common, depth)
        assert len(set(zip(want, got.tolist(), strict=True))) == len(path) == len(set(got.tolist()))


def test_registered_query_with_very_long_text(spark, tmp_path):
    rng = random.Random(6)
    long = [f"w{rng.randrange(3000)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[100:40_000])), (3, " ".join(["new", *long[50_000:50_020]])), (4, "short"), (5, None)]
    spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, n_removed long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in op4_substring_dedup(spark, str(tmp_path)).collect()), key=str) == [r[:4] for r in brute(rows)]
