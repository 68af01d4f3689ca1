"""The trie against dictionaries of prefixes."""

import hashlib
import random
import zlib

import pytest

from medcorpus.llm.op13_prefixes import CHUNK, SearchTree, end_hashes, op13_prefix_trie, prefix_trie, rebuilt, recorded


def nodes_of(convs):
    """convs: sequences of (role, text) by conv_id."""
    members, kids = {}, {}
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
            if d:
                kids.setdefault(s[: d - 1], set()).add(s[:d])
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = kids.get(p, ())
        leaves[p] = sum(leaves[k] for k in own) or 1
        saved[p] = sum(saved[k] for k in own) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, ())), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: tuple(x[2:] for x in sorted(v)) for c, v in own.items()}
    out = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, ())[:h] + s[h:]
    return nodes_of(out)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 7 == 5:
            continue
        for k in range(rng.randrange(1, 14)):
            rows.append((c, k, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "éé", None, "long " * 50])))
    return rows


@pytest.mark.parametrize("shard_turns", [3, 40, 200_000])
def test_same_as_dictionaries(spark, shard_turns):
    rows = conversations(shard_turns, 150) + [(300, None, "user", "x"), (300, 0, "user", "y"), (300, 0, "user", "y"), (300, 0, "a", "z"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*r, "other") for r in rows], "conv_id long, turn int, role string, text string, depth string").repartition(5)
    got = sorted((tuple(r) for r in prefix_trie(rebuilt(recorded(df)), shard_turns).collect()), key=str)
    assert got == brute(rows)


def test_copies_and_a_hot_beginning_over_many_shards(spark):
    rng = random.Random(1)
    rows = [(c, k, "user", "hot" if k < 3 or c % 3 == 0 else rng.choice("abcdefgh")) for c in range(400) for k in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    convs = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        convs[c] = (*convs.get(c, ()), (role, text))
    got = sorted((tuple(r) for r in prefix_trie(recorded(df), 20).collect()), key=str)
    assert got == nodes_of(convs)


def test_ids_in_pieces(spark, monkeypatch):
    import medcorpus.llm.op13_prefixes as op

    assert CHUNK >= 1 << 16
    monkeypatch.setattr(op, "CHUNK", 50)
    ids = {b"a": list(range(-40, 3000, 3)), b"b": [7], b"c": [1, 20, 300], b"d": list(range(500))}
    rows = [(bytearray(k), c) for k, own in ids.items() for c in own]
    random.Random(2).shuffle(rows)
    got = {bytes(r.key): bytes(r.digest) for r in end_hashes(spark.createDataFrame(rows, "key binary, conv_id long").repartition(4)).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(own))).encode()).digest() for k, own in ids.items()}


def test_search_tree_finds_what_was_inserted_and_is_balanced():
    rng = random.Random(4)
    seqs = sorted({tuple(rng.randrange(9) for _ in range(rng.randrange(0, 6))) for _ in range(300)} | {(k,) for k in range(1000)})
    tree = SearchTree()
    ends = tree.insert_sorted([list(s) for s in seqs])
    assert [tree.insert(list(s)) for s in seqs] == ends and len(set(ends)) == len(seqs)
    assert len(tree.symbol) == len({s[:d] for s in seqs for d in range(len(s) + 1)})
    assert all([tree.symbol[v] for v in tree.way(e)[1:]] == list(s) for e, s in zip(ends, seqs, strict=True))

    def height(node):
        return 1 + max(height(tree.low[node]), height(tree.high[node])) if node else 0

    assert height(tree.down[0]) <= 14


def test_empty_table_and_very_long_texts(spark, tmp_path):
    rows = [(1, 0, "user", "t" * 3_000_000), (2, 0, "user", "t" * 3_000_000), (6, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert prefix_trie(recorded(df.limit(0))).count() == 0
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((tuple(r) for r in op13_prefix_trie(spark, str(tmp_path)).collect()), key=str) == brute(rows)
