"""Every registered query with SQL gives what the SQL gives, on the smallest tables."""

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def names():
    from medcorpus.queries import QUERIES

    return sorted(QUERIES)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    from medcorpus.queries import ORACLE_SQL, QUERIES
    from tools.compare import compare

    said = compare(spark, con, name, QUERIES[name], ORACLE_SQL.get(name), SF)
    assert not said.startswith("FAIL"), said


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
@pytest.mark.parametrize("limit", [40, 300])
def test_properties_of_chunks(spark, limit):
    """Within the limit, in order and whole but for a short tail; and none has room for the piece that the next one begins with."""
    from medcorpus.functions.text import paragraphs
    from medcorpus.operators.chunking import SENTENCE_END, half_length, pack_chunks

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("source", "doc_id", "text")
    parts = {r.doc_id: r.p for r in docs.select("doc_id", paragraphs(docs["text"]).alias("p")).collect()}
    chunks = {}
    for r in pack_chunks(docs, limit).collect():
        assert r.n_tokens == half_length(r.text) <= limit and r.text
        chunks.setdefault(r.doc_id, {})[r.chunk_no] = r.text
    bare = lambda s: "".join(s.split())
    shortest, tails, pairs, roomy = 32, 0, 0, 0
    for d, own in parts.items():
        mine = [chunks.get(d, {})[k] for k in range(len(chunks.get(d, {})))]
        whole, kept = bare("".join(own)), bare("".join(mine))
        assert whole.startswith(kept)
        # a dropped tail is shorter than the least number of tokens; a piece of one character counts as one
        assert len(whole) - len(kept) <= 2 * shortest, d
        tails += len(kept) < len(whole)
        for now, after in zip(mine, mine[1:], strict=False):
            paragraph = after.split("\n\n")[0]
            piece = paragraph if paragraph in own and half_length(paragraph) <= limit else SENTENCE_END.split(paragraph)[0]
            # each piece inside a chunk may be half a token more than was counted
            slack = sum(len(SENTENCE_END.split(p)) for p in now.split("\n\n")) + 1
            pairs += 1
            roomy += half_length(now) + 1 + half_length(piece) + slack <= limit
    # chunks that were counted to fit and do not are halved, which leaves room in the halves
    assert len(chunks) > 100 and tails and roomy <= (0.01 if limit == 300 else 0.1) * pairs


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
def test_rouge_against_plain_subsequences(spark):
    import re

    from medcorpus.queries import QUERIES

    def score(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b, 1):
                now.append(row[j - 1] + 1 if x == y else max(row[j], now[-1]))
            row = now
        p, r = row[-1] / max(1, len(a)), row[-1] / max(1, len(b))
        return (1 + 1.44) * p * r / (r + 1.44 * p) if row[-1] else 0.0

    got = {r.item: r.score for r in QUERIES["m15_rouge_l"](spark, SF).collect()}
    words = lambda s: re.findall("[a-z0-9]+", s.lower())
    for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 1500").collect():
        s = r.text.split(".")
        refs = [x for x in s[1:] if x.strip(" ")]
        assert abs(got[r.doc_id] - max((score(words(s[0]), words(x)) for x in refs), default=0.0)) < 1e-9


def test_paragraphs_of_odd_texts(spark, tmp_path):
    from medcorpus.queries.base import QUERIES

    cases = [
        (None, 1, None), ("", 1, 0), (" ", 1, 0), ("\n\n", 1, 0), ("a\n\nb", 1, 3), ("a\n \nb\n", 1, 3), ("中\n文", 1, 3), (" a　\n b ", 1, 3), ("\ta\t", 1, 3), ("a\n" * 10, 1, 19), ("ab\n" * 11, 11, 2),
        ("\n" * 11, 0, None), (" \n\n" * 4 + "abc\n\nd", 1, 5), (" \n\n" * 6 + "abc\n\nd", 2, 3), ("中\n" * 12, 12, 1), ("a\r\nb", 1, 4), ("a\x0b\nb", 1, 4),
    ]
    spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.parts, r.first_chars) for r in QUERIES["k1_paragraphs"](spark, str(tmp_path)).collect()}
    assert got == {k: c[1:] for k, c in enumerate(cases)}
