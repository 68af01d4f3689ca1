"""Every registered query on the smallest tables; where it has SQL, against that."""

from pathlib import Path

import pytest

from medcorpus.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    from tools.compare import compare

    said = compare(spark, con, name, registry.queries()[name], registry.oracle_sql().get(name), SF)
    assert not said.startswith("FAIL"), said


def test_url_filter_sql_with_hosts_without_outcomes(spark, tmp_path):
    import duckdb

    from tools.compare import compare

    pages, labels = [], []
    for d in range(9):
        for k in range(30):
            pages.append((len(pages), f"https://h{k % 3}.d{d}.{'org' if d < 6 else 'co.uk'}/x"))
            labels.append((len(pages) - 1, int(d not in (1, 7)), 0))
    pages += [(900, "http://new.d1.org/"), (901, "http://new.d0.org/a"), (902, "http://new.other.co.uk/"), (903, "http://a.b.info"), (904, None), (905, "nothing")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    for n, own in (("some", labels), ("none", [])):
        (tmp_path / n).mkdir()
        (tmp_path / n / "pages.parquet").symlink_to(tmp_path / "pages.parquet")
        spark.createDataFrame(own, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{n}/labels.parquet")
        con = duckdb.connect()
        for t in ("pages", "labels"):
            con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{n}/{t}.parquet/*.parquet')")
        said = compare(spark, con, "op8_url_filter", registry.queries()["op8_url_filter"], registry.oracle_sql()["op8_url_filter"], f"{tmp_path}/{n}")
        assert said.startswith("same"), said


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
def test_packed_pieces_against_whole_encodings(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from medcorpus.llm.op01_packing import default_tokenizer

    plain, pieces, sequences = Tokenizer.from_file(default_tokenizer()), {}, {}
    for r in registry.queries()["op1_packing"](spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(pieces) == set(docs)
    for d, own in pieces.items():
        ids = np.array(plain.encode(docs[d], add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for start, length, crc, total in sorted(own):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for own in sequences.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    # sequences with 1 % of room or less are written as they are; each partition may leave one with more
    assert sum(n for own in sequences.values() for _, n in own) >= 0.98 * 2048 * len(sequences)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
def test_near_duplicates_against_all_pairs(spark):
    from tests.llm.test_op03 import brute

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {tuple(r) for r in registry.queries()["op3_near_dedup"](spark, SF).collect()} == brute(docs, 3, 85)
