"""The pipeline's stages against plain Python on a small table."""

import random

import corpus_pipeline
from medcorpus.llm.op06_decontam import plain
from medcorpus.llm.shingles import find_words, lowered
from tests.llm.test_op03 import brute


def tables(spark, folder):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ","]) for _ in range(n))
    items = [(k, text(25)) for k in range(5)]
    docs = []
    for d in range(200):
        t = text(rng.randrange(30, 160))
        if d % 5 == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif d % 7 == 0:
            t = docs[rng.randrange(len(docs))][1]
        elif d % 11 == 0:
            own = docs[d - 1][1].split()
            own[rng.randrange(len(own))] = "changed"
            t = " ".join(own)
        elif d % 13 == 0:
            t = text(40) + " " + rng.choice(items)[1].upper() + " " + text(30)
        docs.append((d, t, "en", "src", len(t)))
    docs += [(500, None, "en", "src", 0), (501, "", "en", "src", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, int("!!" not in t), 0) for d, t, *_ in docs[:150]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows, items = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "decontaminate", "packing"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    good = stage["quality"](spark, docs, folder)
    assert good.columns == docs.columns
    kept = set(ids(good))
    clean = {d for d, t, *_ in rows if t and "!!" not in t}
    assert clean <= kept and not any("!!" in (t or "") for d, t, *_ in rows if d in kept)

    last = {}
    for d, t, *_ in rows:
        last[t or ""] = d
    single = stage["exact"](spark, docs, folder)
    assert single.columns == docs.columns and ids(single) == sorted(last.values())

    want = sorted(d for d, _, _, own in brute([(d, t) for d, t, *_ in rows], 5, 80) if own)
    assert ids(stage["near"](spark, docs, folder)) == want

    hit = {d for d, t, *_ in rows if t and any(plain(i) in plain(t) for _, i in items)}
    assert ids(stage["decontaminate"](spark, docs, folder)) == sorted({d for d, *_ in rows} - hit) and hit

    got = corpus_pipeline.run(spark, folder).collect()
    packed = {r.doc_id for r in got}
    left = [(d, t) for d, t, *_ in rows if d in kept]
    left = [(d, t) for d, t in left if d == max(x for x, y in left if (y or "") == (t or ""))]
    firsts = {d for d, _, _, own in brute(left, 5, 80) if own}
    assert packed == firsts - hit
    assert sum(r.length for r in got) == sum(len(r.ids) for r in got) and find_words(lowered("A b")) == ["a", "b"]


def test_edge_cases_of_every_stage(spark, tmp_path):
    item = "the quick brown fox jumps over the lazy dog by the river bank"
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    text = " ".join(rng.choice(words) for _ in range(80))
    long = " ".join(rng.choice(words) for _ in range(50_000))
    rows = [(1, text), (1, text), (2, text + " more"), (3, long), (4, long + " tail"), (5, None), (6, ""), (7, " \n"), (None, "no id here"), (None, "no id here"), (8, f"x {item} y"), (1, "another text of document one")]
    docs = spark.createDataFrame([(d, t, "en", 1, 2, True, "c") for d, t in rows], "doc_id long, text string, lang string, row long, print long, kept boolean, component_id string")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (8, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage, folder = dict(corpus_pipeline.STAGES), str(tmp_path)
    texts = lambda df: sorted(((r.doc_id, (r.text or "")[:40]) for r in df.collect()), key=str)
    all_of = lambda own: sorted(((d, (t or "")[:40]) for d, t in own), key=str)

    good = stage["quality"](spark, docs, folder)
    assert good.columns == docs.columns and set(texts(good)) <= set(all_of(rows))
    single = stage["exact"](spark, docs, folder)
    assert single.columns == docs.columns and texts(single) == all_of([(1, text), (2, text + " more"), (3, long), (4, long + " tail"), (6, ""), (7, " \n"), (None, "no id here"), (8, f"x {item} y"), (1, "another text of document one")])
    near = stage["near"](spark, docs, folder)
    assert near.columns == docs.columns and texts(near) == all_of([r for r in rows if r[0] not in (2, 4)])
    clean = stage["decontaminate"](spark, docs, folder)
    assert clean.columns == docs.columns and texts(clean) == all_of([r for r in rows if r[0] != 8])
    packed = stage["packing"](spark, docs, folder).collect()
    assert sum(r.doc_id == 5 for r in packed) == 1 and sum(r.length for r in packed if r.doc_id == 3) > 50_000
    for f in stage.values():
        assert f(spark, docs.limit(0), folder).count() == 0
