"""Packing against a plain encoding of whole texts."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from medcorpus.llm.op01_packing import RoomTree, WordTokenizer, best_fit_decreasing, default_tokenizer, fill_by_cutting, pack_documents


def check(spark, rows, block_tokens=1 << 22):
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = pack_documents(df, block_tokens=block_tokens).collect()
    plain = Tokenizer.from_file(default_tokenizer())
    want = sorted((d, plain.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows)
    docs = {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, list(r.ids)))
    for d, ids in want:
        if sum(x == d for x, _ in rows) == 1:
            assert [i for _, p in sorted(docs[d, len(ids)]) for i in p] == ids
    assert sum(r.length for r in got) == sum(len(i) for _, i in want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    return sequences


def test_pieces_hold_all_ids(spark):
    odd = ["", None, "<|endoftext|> a <|startoftext|>b", "İstanbul ΑΣ ΣΑΣ　x\x1cy é don't", "a" * 9000, "x y " * 3000, "\n\n", "one"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + i, "word " * (37 * i % 1500)) for i in range(120)] + [(500, "same")] * 3
    sequences = check(spark, rows)
    assert sum(sum(n for _, n in s) < 2048 * 0.99 for s in sequences.values()) <= 2
    check(spark, rows, block_tokens=5000)


def test_words_make_the_text(spark):
    words = WordTokenizer(default_tokenizer(), memory=3)
    plain = Tokenizer.from_file(default_tokenizer())
    texts = ["a b c d e f g a b", "Ça va, l'été!", "x y\x85z\x1fw", "1234 ab12 👍🏽 ok​no"]
    for t, ids in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest():
    placed, rooms = best_fit_decreasing([60, 50, 40, 35], 100)
    assert placed == [0, 1, 0, 1] and rooms == [0, 15]
    tree = RoomTree(100)
    for room in (90, 41, 40):
        tree.add(room, room)
    assert tree.take(41) == (41, 41) and tree.take(41) == (90, 90) and tree.take(41) is None and tree.take(0) == (40, 40)


def test_cutting_leaves_one_with_room():
    got = fill_by_cutting([[(0, 0, 70)], [(1, 0, 60)], [(2, 0, 50)], [(3, 0, 45)]], 100)
    assert sorted(sum(n for _, _, n in s) for s in got) == [25, 100, 100]
    assert sorted(x for s in got for d, a, n in s for x in [(d, i) for i in range(a, a + n)]) == [(d, i) for d, n in enumerate((70, 60, 50, 45)) for i in range(n)]


def test_empty_table_and_clashing_columns(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string, ids string")).count() == 0
    assert pack_documents(spark.createDataFrame([(1, "a", "x", 3)], "doc_id long, text string, ids string, start int")).count() == 1
