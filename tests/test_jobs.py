"""Jobs that begin with files."""

import json
import random
import re
import zipfile

import pytest

from medcorpus.operators import chunking
from medcorpus.plans import jobs


def test_corpus_of_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / "books" / name).mkdir(parents=True)
        (tmp_path / "books" / name / "one.txt").write_bytes(f"first {name}\nLocated at: somewhere\nlast".encode() + b"\xff")
    long = "word " * 60
    rows = [{"id": "1", "source": "who", "title": " T ", "clean_text": f"  {long}"}, {"clean_text": long}, {"id": "3", "clean_text": "short"}, {"id": "4", "title": "", "source": "x", "clean_text": None}]
    (tmp_path / "g.json").write_text(json.dumps(rows))
    (tmp_path / "h.json").write_text("\n".join(json.dumps(r) for r in [{"id": "5", "source": "nice", "title": None, "clean_text": long}]))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/ad.txt", "整形美容 优惠 咨询电话 " * 9)
        z.writestr("in/deep/good.txt", "plain text")
        z.writestr("out/other.txt", "not read")
    archives = {"ads out": (str(tmp_path / "z.zip"), "in/", True), "all": (str(tmp_path / "z.zip"), "in/", False)}
    got = jobs.read_corpus(spark, {"books": str(tmp_path / "books" / "*")}, {"guides": str(tmp_path / "[gh].json")}, archives).collect()
    found = {(r.source, r.doc_id): r.text for r in got}
    assert len(found) == len(got) and {k: v for k, v in found.items() if k[0] == "books"} == {("books", "a/one"): "first a\nlast", ("books", "b/one"): "first b\nlast"}
    assert {k: v for k, v in found.items() if k[0] == "guides"} == {("guides", "who/1"): "T\n\n" + long.strip(), ("guides", "?/?"): long.strip(), ("guides", "nice/5"): long.strip()}
    assert sorted(k for k in found if k[0] in archives) == [("ads out", "good.txt"), ("all", "ad.txt"), ("all", "good.txt")]


def test_report_pool(spark, tmp_path):
    lines = [
        ("7", "1", "/p/2.dcm", "Frontal", "clear\n\"quoted\"", ""), ("7", "1", "//p/1.dcm", "Frontal ", "clear", "fine"), ("7", "1", "/p/0.dcm", "Lateral", "x", ""), ("8", "1", "/p/3.dcm", "Frontal", " ", "\n"),
        ("9", "1", "/p/4.dcm", "Frontal", "seen before", ""), ("5", "2", "/p/5.dcm", "Frontal", "", "only this"), ("5", "3", "/p/6.dcm", "", "no view", ""),
    ]
    text = "patient,study,path,view,findings,impression\n" + "\n".join(",".join('"' + x.replace('"', '""') + '"' for x in r) for r in lines)
    (tmp_path / "r.csv").write_text(text)
    subset = spark.createDataFrame([(9, "/data/films/p/4.dcm", "p/4.dcm"), (1, "/data/films/p/9.dcm", "p/9.dcm")], "patient long, image_path string, path string")
    schema = "patient long, study long, path string, view string, findings string, impression string"
    chosen, funnel = jobs.report_pool(spark, str(tmp_path / "r.csv"), schema, subset, 10, 1)
    assert sorted((r.patient, r.study, r.image_path, r.text) for r in chosen.collect()) == [(5, 2, "/data/films/p/5.dcm", "Impression: only this"), (7, 1, "/data/films/p/1.dcm", "Findings: clear\nImpression: fine")]
    assert {r.step: r.n for r in funnel.collect()} == {"not frontal": 2, "empty": 1, "excluded": 1, "candidate": 3, "study": 2, "patient": 2, "chosen": 2}
    with pytest.raises(ValueError, match="no common root"):
        jobs.report_pool(spark, str(tmp_path / "r.csv"), schema, subset.unionByName(subset.limit(1).selectExpr("patient", "'/other/x' as image_path", "'x' as path")), 10, 1)


def test_clean_corpus_cleans_once(spark):
    """A text is cleaned once, not again for its filter."""
    docs = spark.createDataFrame([(1, "a", "x" * 250 + "\n\n\n\nend"), (2, "b", "short"), (3, "b", "x" * 250 + "\n\n\nend "), (4, "c", None)], "doc_id long, source string, text string")
    clean = jobs.clean_corpus(docs)
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(p) for p in (r"\n{3,}", "Authored by", r"\d{1,4}\s*$")] == [1, 1, 1]
    assert [(r.doc_id, r.text) for r in clean.collect()] == [(1, "x" * 250 + "\n\nend")]


def test_sentences_as_the_pattern_says():
    pattern = re.compile(r"(?<=[。！？；!?;])|(?<=[.!?])\s+")
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice("ab.!?; \n。；\u3000") for _ in range(rng.randrange(14)))
        assert chunking.sentences(text) == [s for s in pattern.split(text) if s.strip()]


def test_report_pool_moves_no_texts(spark, tmp_path, monkeypatch):
    """Rows meet the excluded patients without their texts, even where that takes a shuffle; the chosen studies are known when texts meet them."""
    (tmp_path / "r.csv").write_text("patient,study,path,view,findings,impression\n1,2,/p,Frontal,seen,\n3,4,/q,Frontal,seen,\n")
    subset = spark.createDataFrame([(3, "/d/q", "q")], "patient long, image_path string, path string")
    stored, tables = jobs.stored, []
    monkeypatch.setattr(jobs, "stored", lambda x: tables.append(x) or stored(x))
    chosen, _ = jobs.report_pool(spark, str(tmp_path / "r.csv"), "patient long, study long, path string, view string, findings string, impression string", subset, 10, 1)
    assert [tuple(r) for r in chosen.select("patient", "study", "path", "text").collect()] == [(1, 2, "p", "Findings: seen")]
    joins = [t._jdf.queryExecution().optimizedPlan() for t in tables]
    for k, plan in enumerate(joins):
        while plan.nodeName() != "Join" and plan.children().size():
            plan = plan.children().head()
        joins[k] = plan.children().head().output().mkString(" ") if plan.nodeName() == "Join" else ""
    assert "own" in joins[0] and "findings" not in joins[0] and "impression" not in joins[0]
    assert [t.columns for t in tables][2] == ["patient", "study", "path"]
