"""Readers of large single files, and results that are whole or not there."""

import csv
import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from medcorpus import storage
from medcorpus.operators import sampling
from medcorpus.sources import ranges, readers
from medcorpus.streaming import incremental


@pytest.fixture
def split_at(spark):
    """Sets the bytes of a range."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]

    def set_bytes(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "0")

    yield set_bytes
    for k, v in zip(keys, old, strict=True):
        spark.conf.set(k, v)


def messy(rng, alphabet):
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 12)))


@pytest.mark.parametrize("size", [24, 61, 100_000])
def test_quoted_lines_over_every_border(spark, tmp_path, split_at, size):
    rng = random.Random(size)
    rows = [(k, messy(rng, 'a,"\n\r é{}')) for k in range(25)]
    out = io.StringIO()
    w = csv.writer(out, quoting=csv.QUOTE_NONNUMERIC, lineterminator=rng.choice(["\n", "\r\n"]))
    w.writerow(["id", "te\nxt"])
    w.writerows(rows)
    (tmp_path / "r.csv").write_text(out.getvalue(), encoding="utf-8", newline="")
    split_at(size)
    got = sorted((r.id, r.text or "") for r in readers.read_reports_csv(spark, str(tmp_path / "r.csv"), "id long, text string").collect())
    assert got == rows


def test_a_file_that_ends_inside_quotes_is_an_error(spark, tmp_path):
    (tmp_path / "r.csv").write_text('id,text\n1,"a\n2,b\n')
    with pytest.raises(ValueError, match="inside quotes"):
        readers.read_reports_csv(spark, str(tmp_path / "r.csv"), "id long, text string")


@pytest.mark.parametrize(("size", "indent"), [(31, None), (90, 3), (100_000, None)])
def test_arrays_over_every_border(spark, tmp_path, split_at, size, indent):
    rng = random.Random(size)
    rows = [{"id": k, "text": messy(rng, '{}[]",\\\n: é'), "more": {"a": [messy(rng, '}{"\\'), "x"]}} for k in range(15)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False), encoding="utf-8")
    split_at(size)
    got = readers.read_json_any(spark, str(tmp_path / "a.json"), "id long, text string, more struct<a: array<string>>")
    assert sorted((r.id, r.text, r.more.a) for r in got.collect()) == [(r["id"], r["text"], r["more"]["a"]) for r in rows]


def test_folder_of_arrays_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text("﻿\n [ ]")
    (tmp_path / "b.json").write_text('\n[{"x": 1}, {"x": 2}]\n')
    (tmp_path / "c.json").write_text('\n{"x": 3}\n{"x": 4}\n')
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.json").write_text('[{"x": "no number"}]')
    assert sorted((r.x for r in readers.read_json_any(spark, str(tmp_path), "x long").collect()), key=str) == [1, 2, 3, 4, None]
    assert sorted(r.x for r in readers.read_json_any(spark, [str(tmp_path / "b.json")], "x long").collect()) == [1, 2]


def test_one_file_is_many_tasks(spark, tmp_path, split_at):
    rows = [{"id": k, "text": f'line "{k}"\nand {{more}} ' + "x" * 200} for k in range(8000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    with open(tmp_path / "r.csv", "w", newline="") as f:
        csv.writer(f, quoting=csv.QUOTE_ALL).writerows([["id", "text"], *[r.values() for r in rows]])
    split_at(100_000)
    for name, separator in (("a.json", "}"), ("r.csv", "\n")):
        assert ranges.pieces(spark, str(tmp_path / name), separator).rdd.getNumPartitions() > 8
    want = sorted((r["id"], r["text"]) for r in rows)
    assert sorted(tuple(r) for r in readers.read_json_any(spark, str(tmp_path / "a.json"), "id long, text string").collect()) == want
    assert sorted(tuple(r) for r in readers.read_reports_csv(spark, str(tmp_path / "r.csv"), "id long, text string").collect()) == want


def test_bytes_that_are_no_text_are_left_out(spark, tmp_path):
    texts = [b"ab\xff\xfecd", b"\xe4\xb8\xad\xe4\xb8", "�kept".encode() + b"\x80", b"\xed\xa0\x80x", b"\xf0\x9f\x91", b"plain \xc3\xa9"]
    (tmp_path / "d").mkdir()
    for k, t in enumerate(texts):
        (tmp_path / "d" / f"t{k}.txt").write_bytes(t)
    got = {r.doc_id: r.text for r in readers.read_text_docs(spark, str(tmp_path / "d")).collect()}
    assert got == {f"d/t{k}": t.decode("utf-8", "ignore") for k, t in enumerate(texts)}


class Lost(Exception):
    pass


def lose(monkeypatch, name, after=0):
    """Lets calls of a function of storage fail from the given one on."""
    real, calls = getattr(storage, name), []

    def failing(*a, **b):
        calls.append(1)
        if len(calls) > after:
            raise Lost
        return real(*a, **b)

    monkeypatch.setattr(storage, name, failing)


@pytest.mark.parametrize("step", ["write_data", "enter"])
def test_a_training_set_is_the_one_before_until_it_is_entered(spark, tmp_path, monkeypatch, step):
    folder, registry = str(tmp_path / "sets"), str(tmp_path / "registry")
    readers.write_training_set(spark.range(3), folder, "x", registry)
    with monkeypatch.context() as m:
        lose(m, step)
        with pytest.raises(Lost):
            readers.write_training_set(spark.range(9).withColumn("y", F.lit(1)), folder, "x", registry)
    assert readers.read_training_set(spark, registry, "x").count() == 3
    assert [r.columns for r in readers.read_registry(spark, registry).collect()] == [["id"]]
    readers.write_training_set(spark.range(9), folder, "x", registry)
    assert readers.read_training_set(spark, registry, "x").count() == 9
    storage.delete_unentered(spark, f"{folder}/x", f"{registry}/x")
    assert len(list((tmp_path / "sets" / "x").iterdir())) == 2  # this version and the one before
    readers.write_training_set(spark.range(5), folder, "x", registry)
    assert readers.read_training_set(spark, registry, "x").count() == 5 and len(list((tmp_path / "sets" / "x").iterdir())) == 2


@pytest.mark.parametrize("step", ["write_data", "enter"])
def test_a_split_is_written_once_and_whole(spark, tmp_path, monkeypatch, step):
    split, path = spark.createDataFrame([(1, "train"), (2, "test")], "id long, half string"), str(tmp_path / "split")
    (tmp_path / "split" / "_temporary").mkdir(parents=True)  # what a lost writer leaves
    with monkeypatch.context() as m:
        lose(m, step)
        with pytest.raises(Lost):
            sampling.write_split_once(split, path)
    assert sampling.write_split_once(split, path).count() == 2
    assert sampling.write_split_once(split.limit(0), path).count() == 2


def test_of_two_entries_the_first_stays(spark, tmp_path):
    root = str(tmp_path / "r")
    assert storage.enter(spark, root, "a", {"n": 1}) and not storage.enter(spark, root, "a", {"n": 2})
    assert storage.entries(spark, root) == {"a": {"n": 1}} and storage.entries(spark, str(tmp_path / "none")) == {}


@pytest.mark.parametrize(("step", "after"), [("write_data", 1), ("enter", 1), ("enter", 0)])
def test_a_stream_that_is_killed_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, step, after):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in range(4):
        spark.createDataFrame([("t", i) for i in range(k * 5, k * 5 + 10)], "tag string, id long").coalesce(1).write.mode("append").json(src)
    with monkeypatch.context() as m:
        lose(m, step, after)
        with pytest.raises(Exception, match="Lost"):
            incremental.ingest_predictions(spark, src, "tag string, id long", out, state, files_a_batch=1, buckets=4)
    incremental.ingest_predictions(spark, src, "tag string, id long", out, state, files_a_batch=1, buckets=4)
    assert sorted(r.id for r in incremental.read_ingested(spark, out, "tag string, id long").collect()) == list(range(25))
    # a key with a null is a key; a batch without anything new is entered, too
    spark.createDataFrame([("t", None), (None, 3)], "tag string, id long").coalesce(1).write.mode("append").json(src)
    spark.createDataFrame([("t", None), (None, 3), ("t", 4)], "tag string, id long").coalesce(1).write.mode("append").json(src)
    incremental.ingest_predictions(spark, src, "tag string, id long", out, state, files_a_batch=1, buckets=4)
    want = {*(("t", k) for k in range(25)), ("t", None), (None, 3)}
    rows = [tuple(r) for r in incremental.read_ingested(spark, out, "tag string, id long").collect()]
    assert len(rows) == 27 and set(rows) == want
    # nothing is held as state
    assert not (tmp_path / "state" / "state").exists()


def test_a_file_a_document_with_its_id(spark, tmp_path):
    from collections import Counter

    from medcorpus.queries import QUERIES

    rows = [(1, "a/b c+d", "x\n"), (1, "a/b c+d", "x\n"), (-2, None, "é"), (None, "web", ""), (3, "web", None), (4, "", "y"), (5, "%41_1", "z")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, QUERIES["s3_read_text_docs"](spark, str(tmp_path)).select("doc_id", "source", "text_md5").collect()))
    assert got == Counter((d, s, hashlib.md5(((t or "") + "\n").encode()).hexdigest()) for d, s, t in rows)
    docs = spark.range(30).select(F.lit("f").alias("folder"), F.col("id").cast("string").alias("stem"), F.col("id").cast("string").alias("text"))
    assert readers.write_text_docs(docs, f"{tmp_path}/out", "folder", "stem", "text") == 30
    assert sorted(r.text for r in readers.read_text_docs(spark, f"{tmp_path}/out/*").collect()) == sorted(map(str, range(30)))
    assert not [p for p in (tmp_path / "out" / "f").iterdir() if p.name.startswith("_")]


def test_any_text_comes_back_from_a_table_in_quotes(spark, tmp_path):
    from medcorpus.queries.base import QUERIES

    texts = [None, "", " ", "\n", " a ", "\ta\x0b\n", "\r", "a\r\n", '"', '""', 'a"', "\\", '\\"', "\0", "\0a\0 \0", " a　", "null", "\\N", ",", "#a", "﻿a", " "]
    rows = [(None, "x"), (-1, "y"), *enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["s2_read_reports_csv"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    # without a value of its own for what is missing, an empty field is missing
    (tmp_path / "r.csv").write_text('id,text\n1,""\n2,\n')
    assert [r.text for r in readers.read_reports_csv(spark, str(tmp_path / "r.csv"), "id long, text string").collect()] == [None, None]


@pytest.mark.parametrize("name", ["r.csv", "r.csv.gz"])
def test_records_are_stored_only_if_files_are_cut(spark, tmp_path, split_at, monkeypatch, name):
    import gzip

    text = 'id,text\n' + "".join(f'{k},"a ""{k}""\n{"x" * k}"\n' for k in range(60))
    (tmp_path / name).write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
    stored, tables = ranges.stored, []
    monkeypatch.setattr(ranges, "stored", lambda x: tables.append(x.columns) or stored(x))
    for size in (100_000, 90):
        tables.clear()
        split_at(size)  # or less: a file that can be cut is one range for each core at least
        got = sorted(tuple(r) for r in readers.read_reports_csv(spark, str(tmp_path / name), "id long, text string").collect())
        assert got == [(k, f'a "{k}"\n{"x" * k}') for k in range(60)]
        assert sum("text" in columns for columns in tables) == (name == "r.csv")
