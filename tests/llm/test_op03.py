"""Near-duplicates against all pairs of a small table."""

import random

import numpy as np
import pytest

from medcorpus.llm.components import components
from medcorpus.llm.op03_near import Linker, can_be_linked, least_matches, near_duplicates, op3_near_dedup, rarest, sharing
from medcorpus.llm.shingles import find_words, lowered


def brute(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = find_words(lowered(t or ""))
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        sets[d] = s
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(d, len(sets[d]), root(d), root(d) == d) for d in ids}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_same_as_all_pairs(spark, size, percent):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows, d = [], 0
    for _ in range(6):
        text = [rng.choice(words) for _ in range(120)]
        for _ in range(45):
            own = list(text)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((d := d + 1, " ".join(own)))
    rows += [(900, ""), (901, None), (902, " \n\t"), (903, "One"), (904, "one"), (905, "one two"), (906, "Éa Ä x y"), (907, "éa ä x y")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, n long").repartition(4)
    assert {tuple(r) for r in near_duplicates(df, size, percent).collect()} == brute(rows, size, percent)


def test_wide_buckets_are_the_same_as_all_pairs(spark, monkeypatch):
    import medcorpus.llm.op03_near as op

    called, real = [], op.that_can_meet
    monkeypatch.setattr(op, "BLOCK", 6)
    monkeypatch.setattr(op, "that_can_meet", lambda at, rare: called.append(at.count()) or real(at, rare))
    rng = random.Random(15)
    words = [f"w{k}" for k in range(900)]
    rows, d = [], 0
    for _ in range(3):
        text = [rng.choice(words) for _ in range(70)]
        for k in range(40):
            own = list(text)
            for at in range(rng.choice([1, 6, 14])):
                own[-1 - at] = rng.choice(words)  # alike in front, linked or not
            rows.append((d := d + 1, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {tuple(r) for r in near_duplicates(df, 5, 80).collect()} == brute(rows, 5, 80) and called


def test_members_that_can_meet_none_are_left_out(spark):
    from medcorpus.llm.op03_near import that_can_meet

    sets = {1: [1, 2], 2: [2, 3], 3: [9], 4: [1], 5: [7, 8], 6: [7], 7: [5]}
    rare = spark.createDataFrame([(d, bytearray(np.array(s, dtype=np.uint32).tobytes())) for d, s in sets.items()], "id long, rare binary")
    at = [(10, 1, 1), (10, 2, 2), (10, 3, 3), (10, 4, 1), (20, 4, 1), (20, 1, 1), (20, 5, 5), (20, 6, 6), (30, 7, 7)]
    got = that_can_meet(spark.createDataFrame(at, "bucket long, id long, component long"), rare).collect()
    assert sorted((r.bucket, r.id) for r in got) == [(10, 1), (10, 2), (20, 5), (20, 6)]
    # many that share nothing cost a row each for their rare shingles, and go nowhere
    n = 3000
    alone = spark.createDataFrame([(k, bytearray(np.arange(3 * k, 3 * k + 3, dtype=np.uint32).tobytes())) for k in range(n)], "id long, rare binary")
    assert that_can_meet(spark.range(n).selectExpr("1L as bucket", "id", "id as component"), alone).count() == 0


def test_defined_cases(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "x y z u v"), (2, "a b c d"), (5, "x y z u v")], "doc_id long, text string")
    got = sorted(near_duplicates(df, 3, 85).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (5, 1, False), (None, None, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "a long, b long")
    assert dict(components(edges).collect()) == {k: 1 for k in range(2, 41)} | {101: 100}


def test_least_matches():
    assert least_matches(512, 0.85, 1e-4) < 512 * 0.8 < least_matches(512, 0.85, 0.5)
    assert np.all(np.diff([least_matches(512, t, 1e-4) for t in (0.5, 0.7, 0.9)]) > 0)


def test_alike_but_unlinked_texts_make_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    head = [rng.choice(words) for _ in range(52)]
    pairs, links = [], Linker.links
    monkeypatch.setattr(Linker, "links", lambda self, found: pairs.append(found.count()) or links(self, found))
    made = []
    for n in (200, 400):
        pairs.clear()
        rows = [(k, " ".join([*head, *(rng.choice(words) for _ in range(8))])) for k in range(n)]
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
        assert all(r.kept for r in got) and len(got) == n
        made.append(sum(pairs))
    assert made[1] < 3 * made[0] + 200 and made[1] < 4000


def test_linked_sets_share_a_rarest_shingle():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 9, 1 << 18)
    base = [np.unique(rng.integers(0, 1 << 63, rng.integers(1, 80), dtype=np.uint64)) for _ in range(12)]
    new = lambda n: rng.integers(0, 1 << 63, rng.integers(0, 1 + n // 8), dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(a)[: len(a) - rng.integers(0, 1 + len(a) // 8)], new(len(a))])) for a in base * 12]
    n = np.array(list(map(len, sets)))
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (n[i] + n[j] - k)}
    found = sharing([rarest(s, counts, 80).tobytes() for s in sets], n, np.zeros(len(sets), dtype=int), 80)
    assert linked and linked <= set(zip(*(c.tolist() for c in found), strict=True))
    i, j = np.nonzero(np.triu(np.ones((len(sets),) * 2, dtype=bool), 1))
    may = can_be_linked([s.astype(np.uint16).tobytes() for s in sets], i, j, 80)
    passed = set(zip(i[may].tolist(), j[may].tolist(), strict=True))
    assert linked <= passed and len(passed) <= len(linked) + 5


def test_very_long_and_registered(spark, tmp_path):
    rng = random.Random(2)
    long = [f"w{rng.randrange(50_000)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-50], "end"])), (3, "short one here"), (4, None)]
    spark.createDataFrame([(a, b, a) for a, b in rows], "doc_id long, text string, component_id long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in op3_near_dedup(spark, str(tmp_path)).collect()} == brute(rows, 3, 85)
