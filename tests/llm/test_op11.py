"""Token counts against the library's own encoding."""

import json
import random

import pyarrow as pa
import pytest

from medcorpus.llm.op11_tokens import MergeTable, TokenCounter, count_tokens, op11_token_counts

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = ["", " ", "a", "aaaaaaaaaaaaa", "aaaa" * 900, "it's WE'LL don't", "3.14159 1,000", "École été é", "İstanbul Σίσυφος", "你好世界" * 50, "\U0001f44d\U0001f3fd ok", "x<|endoftext|>y", "<|startoftext|><|endoftext|>", "<|im_start|>", "a\x1cb\x85c d e", "\t\r\n tabs", "́ alone", "fiﬁ Ⅷ ½", "x" * 3 + "​" + "y", "'s's'S"]


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path(name), Tokenizer.from_file(public_tokenizers.path(name))


def texts(seed, n=300):
    rng = random.Random(seed)
    alphabets = ["abcde ", "thing er on an ", "éèßñ á", "09 .,-#", "中文字 ", "AbC'sT ll", "́èo "]
    out = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(0, 200))) for _ in range(n)]
    return out + [rng.choice(out) + rng.choice(["<|endoftext|>", "<|x|>", " "]) + rng.choice(out) for _ in range(50)]


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_same_as_library(name):
    path, plain = library(name)
    rows = ODD + texts(1)
    got = TokenCounter(path).count(pa.array(rows)).tolist()
    assert got == [len(e.ids) for e in plain.encode_batch(rows, add_special_tokens=False)]


def test_memory_is_emptied_and_slices_are_independent():
    path, plain = library(WORD)
    counter, rows = TokenCounter(path, memory=20), texts(2)
    whole = pa.array(["before", *rows])
    got = [n for at in range(1, len(whole), 37) for n in counter.count(whole.slice(at, 37)).tolist()]
    assert got == [len(plain.encode(t, add_special_tokens=False).ids) for t in rows]


def test_one_long_word():
    path, plain = library(WORD)
    rng = random.Random(3)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(60_000))
    assert TokenCounter(path).count(pa.array([word])).tolist() == [len(plain.encode(word, add_special_tokens=False).ids)]


def test_merges_in_a_wrong_order_are_refused(tmp_path):
    path, _ = library(WORD)
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    said["model"]["merges"].reverse()
    (tmp_path / "odd.json").write_text(json.dumps(said), encoding="utf-8")
    with pytest.raises(ValueError):
        MergeTable(str(tmp_path / "odd.json"))


def test_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (3, "", "z"), (4, "word " * 3000, "w")]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_tokens string")
    got = count_tokens(df, limit=2)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, 3, 2, False), (1, 3, 2, False), (None, 0, 0, False), (3, 0, 0, False), (4, 15000, 3000, True)], key=str)
    assert count_tokens(df.limit(0)).count() == 0


def test_registered_query(spark):
    _, plain = library(WORD)
    got = {r.doc_id: tuple(r)[1:] for r in op11_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = {d: (len(t.encode()), n := len(plain.encode(t, add_special_tokens=False).ids), n > 2048) for d, t in docs.items()}
    assert got == want
