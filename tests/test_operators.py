"""Operators on small tables: properties that SQL does not show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from medcorpus.operators import chunking as K
from medcorpus.operators import dedupe, isolation, sampling, vectors
from medcorpus.operators.resample import bootstrap_ci, paired_diff_ci
from medcorpus.plans import jobs
from medcorpus.sources import readers
from medcorpus.streaming import incremental


def words(text):
    return len(text.split()) or 1


def test_chunks_keep_the_text_and_the_limit():
    parts = ["one two three four five six. " * 9, "seven eight. " * 3, "x" * 400, "末尾。" * 30, "a b"]
    for limit in (5, 20, 60):
        chunks = K.chunk_document(parts, words, limit, shortest=1)
        assert all(words(c) <= limit for c in chunks)
        assert "".join("".join(chunks).split()) == "".join("".join(parts).split())
    assert K.chunk_document(["a b c"], words, 50, shortest=10) == []
    assert K.chunk_document(["w " * 18, "a b"], words, 18, shortest=5) == [("w " * 18).strip() if False else "w " * 18]


def test_short_tail_joins_or_goes():
    assert K.chunk_document(["a " * 8, "b " * 9, "c d"], words, 12, shortest=4)[-1].endswith("c d")


def test_budget_is_never_exceeded_and_is_stable(spark):
    rows = [("s", d, k, 1 + (d * 7 + k) % 5) for d in range(60) for k in range(4)]
    df = spark.createDataFrame(rows, "source string, doc_id long, chunk_no int, n_tokens long")
    got = {tuple(r) for r in K.take_token_budget(df, 200, 1).collect()}
    assert 190 < sum(r[3] for r in got) <= 200
    assert got == {tuple(r) for r in K.take_token_budget(df.repartition(7), 200, 1).collect()}
    assert K.take_token_budget(df, 0, 1).count() == 240 and K.take_token_budget(df, -1, 1).count() == 0


def test_validation_split(spark):
    docs = spark.createDataFrame([("a", d, k) for d in range(40) for k in range(3)] + [("b", d, k) for d in range(5) for k in range(300)] + [("c", 0, k) for k in range(10)], "source string, doc_id long, chunk_no int")
    got = sampling.val_split_by_document(docs, 0.05, 3).filter("split = 'val'").collect()
    by = lambda s: [(r.doc_id, r.chunk_no) for r in got if r.source == s]
    assert len(by("a")) == 6 and len({d for d, _ in by("a")}) == 2
    assert len(by("b")) == 75 and {k for _, k in by("b")} == set(range(225, 300)) and by("c") == []


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    for f in (lambda x: sampling.sample_n(x, 20, 1, "id"), lambda x: sampling.sample_per_group(x, "g", 7, 1, "id"), lambda x: sampling.stratified_half_split(x, "g", "id", 2)):
        assert sorted(map(tuple, f(df).collect())) == sorted(map(tuple, f(df.repartition(9)).collect()))
    assert sampling.sample_n(df, 0, 1, "id").count() == 500
    over = sampling.oversample_per_group(df.filter("g = 0 or id < 10"), "g", "id", 50, 1)
    assert {r.g: r.n for r in over.groupBy("g").agg(F.count("*").alias("n")).collect()} == {0: 50, 1: 50, 2: 50}


def test_kept_rows_alone_count_as_seen(spark):
    rows = [(1, "a", "k1"), (2, "a", "k2"), (3, "b", "k2"), (4, "b", "k3")]
    df = spark.createDataFrame(rows, "id long, s string, k string")
    assert sorted(r.id for r in dedupe.dedupe_across_sources(df, "s", ["a", "b"], "k", "id", {"a": 1, "b": 9}).collect()) == [1, 3, 4]


def test_contamination(spark):
    q = spark.createDataFrame([("t", "A 45-year-old man has chest pain and a long history of smoking."), ("t", "短题"), ("t", None)], "source string, text string")
    rows = [(1, "a 45 year old man, has chest pain; and a long history of SMOKING"), (2, "短题！"), (3, "短题目"), (4, "an entirely different question about the knee joint and more"), (5, None)]
    got = isolation.contamination(spark.createDataFrame(rows, "id long, text string"), "id", "text", q).filter("contaminated")
    assert sorted(r.id for r in got.collect()) == [1, 2]


def test_intervals(spark):
    rng = np.random.default_rng(1)
    scores = rng.integers(0, 2, 400).astype(float)
    df = spark.createDataFrame([("a", i, float(s)) for i, s in enumerate(scores)] + [("b", i, float(s)) for i, s in enumerate(scores)], "tag string, item long, score double")
    r = bootstrap_ci(df, ["tag"], "score").filter("tag = 'a'").first()
    direct = np.sort([rng.choice(scores, 400).mean() for _ in range(2000)]) * 100
    assert r.lo < r.mean < r.hi and abs(r.lo - direct[50]) < 1 and abs(r.hi - direct[1949]) < 1
    d = paired_diff_ci(df.withColumn("sub", F.lit("x")), ["sub"], ["item"], "a").first()
    assert (d.mean, d.lo, d.hi, d.significant) == (0.0, 0.0, 0.0, False)


def test_longest_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b, 1):
                now.append(row[j - 1] + 1 if x == y else max(row[j], now[-1]))
            row = now
        return row[-1]

    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 6, rng.integers(1, 30))] for _ in range(2))
        n = plain(a, b)
        p, r = n / len(a), n / len(b)
        assert vectors._lcs_f(a, b, 1.2) == pytest.approx(2.44 * p * r / (r + 1.44 * p) if n else 0.0)
    assert vectors._lcs_f([], ["a"], 1.2) == 0.0


def test_ranks_in_blocks(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(60, 5)), rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "id long, a array<double>, b array<double>")
    sim = a @ b.T
    want = {i: (int((sim[i] > sim[i, i]).sum()), int((sim[:, i] > sim[i, i]).sum())) for i in range(60)}
    assert {r.id: (r.rank_ab, r.rank_ba) for r in vectors.retrieval_ranks(df, block=16).collect()} == want


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "a.json").write_text('\n [{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 3}\n{"x": 4}\n')
    assert [sorted(r.x for r in readers.read_json_any(spark, str(tmp_path / f), "x long").collect()) for f in ("a.json", "b.json")] == [[1, 2], [3, 4]]
    (tmp_path / "r.csv").write_text('path,text\n/a/b,"line ""one""\nline two"\n')
    assert tuple(readers.read_reports_csv(spark, str(tmp_path / "r.csv"), "path string, text string", "path").first()) == ("a/b", 'line "one"\nline two')
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "one.txt").write_text("a\nb")
    assert tuple(readers.read_text_docs(spark, str(tmp_path / "docs")).first()) == ("docs/one", "a\nb")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("p/x.txt", "eins")
        z.writestr("q/y.txt", "zwei")
    assert [tuple(r) for r in readers.read_zip_members(spark, str(tmp_path / "z.zip"), "p/").collect()] == [("p/x.txt", "eins")]
    (tmp_path / "abstracts_base_preds.jsonl").write_text('{"id": 1}\n')
    assert tuple(readers.read_predictions(spark, str(tmp_path / "*_preds.jsonl"), "id long").first()) == ("abstracts", "base", 1)
    registry = str(tmp_path / "sets")
    for name, fmt in (("one", "parquet"), ("two", "json"), ("one", "parquet")):
        readers.write_training_set(spark.range(3), str(tmp_path), name, registry, fmt, {"user": "role"})
    assert sorted((r.name, r.format, r.columns, r.roles) for r in readers.read_registry(spark, registry).collect()) == [("one", "parquet", ["id"], {"user": "role"}), ("two", "json", ["id"], {"user": "role"})]
    assert sorted(r.id for r in readers.read_training_set(spark, registry, "two").collect()) == [0, 1, 2]
    with pytest.raises(ValueError, match="no training set"):
        readers.read_training_set(spark, registry, "three")


def test_stream_goes_on(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = lambda *ids: spark.createDataFrame([("t", i) for i in ids], "tag string, id long")
    rows(1, 2, 2).write.json(src)
    incremental.ingest_predictions(spark, src, "tag string, id long", out, state)
    rows(2, 3).write.mode("append").json(src)
    incremental.ingest_predictions(spark, src, "tag string, id long", out, state)
    assert sorted(r.id for r in incremental.read_ingested(spark, out, "tag string, id long").collect()) == [1, 2, 3]


def test_corpus_job_conserves_words(spark):
    docs = spark.createDataFrame([("s", d, " ".join(f"w{d}x{k}" for k in range(120))) for d in range(30)], "source string, doc_id long, text string")
    q = spark.createDataFrame([("t", " ".join(f"w3x{k}" for k in range(60)))], "source string, text string")
    got = jobs.build_corpus(docs, q, 0.05, 100, 0, 1)
    assert {r.doc_id for r in got.collect()} == set(range(30)) - {3}
    assert got.agg(F.max("n_tokens")).first()[0] <= 100 and got.filter("split = 'val'").count() > 0


def test_a_counter_of_nothing():
    assert K.chunk_document(["Well. ? Yes."], lambda s: len(s.split()) - 1 if s != "?" else 0, 1, shortest=0)
    assert K.within_limit("", len, 3) == [] and K.within_limit("abcdef", len, 3) == ["abc", "def"]
    assert K.within_limit("ab\n\ncd ef", len, 6) == ["ab", "cd ef"] and K.within_limit("abcd\n\nef", len, 5) == ["abcd", "ef"] and K.within_limit("  x", len, 3) == ["  x"]
    assert K.within_limit("a\n\nbb\n\nccc\n\ndddd", len, 4) == ["a", "bb", "ccc", "dddd"] and K.within_limit("abc", lambda s: 9, 1) == ["a", "b", "c"]


def test_chunks_are_as_large_as_they_can_be():
    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes, gaps = rng.integers(1, 9, 40), rng.integers(0, 3, 40)
        begins = K.cut_places(sizes, gaps, 12)
        cost = lambda a, b: int(sizes[a:b].sum() + gaps[a + 1 : b].sum())
        for a, b in zip(begins, [*begins[1:], 40], strict=True):
            assert cost(a, b) <= 12 and (b == 40 or cost(a, b + 1) > 12)


def test_every_text_of_a_key_is_judged_by_itself(spark):
    rng = np.random.default_rng(6)
    item = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 140))
    q = spark.createDataFrame([("t", item)], "source string, text string")
    # each text has 30 of its 80 windows in the index; together they would have 60 of 80
    other = lambda k: "".join(rng.choice(list("0123456789"), 50))
    texts = [(1, item[:49] + other(1)), (1, item[40:89] + other(2)), (2, item[:95] + other(3)), (2, "another text of this key that shares nothing with it"), (3, "x" * 60)]
    df = spark.createDataFrame(texts, "id long, text string")
    got = sorted((r.id, r.n_hits, r.contaminated) for r in isolation.contamination(df, "id", "text", q).collect())
    assert got == [(1, 30, False), (1, 30, False), (2, 76, True)]
    assert sorted(r.id for r in isolation.decontaminate(df, "id", "text", q).collect()) == [1, 1, 3]


def plain_contamination(rows, items, chars=20):
    norm = lambda t: "".join(c for c in t if c.isalnum()).lower()
    keys = {norm(x) for x in items}
    index = {k[i : i + chars] for k in keys for i in range(len(k) - chars + 1)}
    out = set()
    for d, t in {(d, norm(t)) for d, t in rows}:
        own = {t[i : i + chars] for i in range(len(t) - chars + 1)}
        if t and (own & index or t in keys):
            out.add((d, len(own & index), len(own), t in keys))
    return out


@pytest.mark.parametrize("at_once", [50, 1 << 21])
def test_contamination_is_that_of_all_windows(spark, monkeypatch, at_once):
    monkeypatch.setattr(isolation, "CHARS_AT_ONCE", at_once)
    rng = np.random.default_rng(9)
    text = lambda n: "".join(rng.choice(list("abé中 ,x"), n))
    items = [text(60) for _ in range(20)] + ["abab" * 20, "short", "中"]
    rows = [(k, text(40) + (items[k % 20][5:50] if k % 3 else "") + text(7)) for k in range(90)] + [(90, "Short!"), (91, items[0]), (91, items[0]), (92, "ab" * 500), (93, "!?"), (94, "long " * 9000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    q = spark.createDataFrame([("t", x) for x in items], "source string, text string")
    got = [(r.id, r.n_hits, r.n_windows, r.exact) for r in isolation.contamination(df, "id", "text", q).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_contamination(rows, items)


def test_few_windows_pass_the_filter_of_a_large_index(spark):
    from medcorpus.operators.blooms import bloom_of

    n = 300_000
    filled = bloom_of(spark.range(n).select(F.xxhash64("id").alias("h")), "h", n)
    others = spark.range(n, 2 * n).select(F.xxhash64("id").alias("h")).toArrow().column(0).to_numpy().view(np.uint64)
    own = spark.range(n).select(F.xxhash64("id").alias("h")).toArrow().column(0).to_numpy().view(np.uint64)
    assert len(filled.where(own)) == n and len(filled.where(others)) < 0.001 * n


def dialogue(c, source, *texts):
    return [(source, c, k, "user" if k % 2 == 0 else "assistant", x) for k, x in enumerate(texts)]


def test_dialogues_of_several_sources(spark):
    asked = "Which of the following drugs lowers blood pressure most in the elderly patient?"
    answer = "a long enough answer"
    turns = dialogue("a1", "a", "first question", answer) + dialogue("a2", "a", "First question!", answer) + dialogue("a3", "a", asked, answer, "x" * 400, answer)
    turns += dialogue("a4", "a", "harmless start", answer, asked, answer) + dialogue("b1", "b", "first question?", answer) + dialogue("b2", "b", "second question", answer) + dialogue("b3", "b", "a question that is too long", "y" * 9000)
    df = spark.createDataFrame(turns, "source string, conv_id string, turn int, role string, text string")
    q = spark.createDataFrame([("t", asked)], "source string, text string")
    out = jobs.build_dialogues(df, q, {"a": 5, "b": 5}, 900, 1, 3.0)
    got = {r.conv_id: (r.reason, r.kept) for r in out.collect()}
    one, two = sorted([got["a1"], got["a2"]], key=str)
    assert {one, two} == {("duplicate", False), (None, True)} and got["a3"] == got["a4"] == ("contaminated", False)
    assert got["b1"] == ("duplicate", False) and got["b2"] == (None, True) and got["b3"] == ("long", False)
    from medcorpus.operators.dialogues import target_stats

    stats = {r.source: r for r in target_stats(out, df.groupBy("source").agg(F.count_distinct("conv_id").alias("total")), {"a": 5, "b": 5}).collect()}
    assert stats["a"].kept == 1 and stats["a"].dropped == {"duplicate": 1, "contaminated": 2} and stats["b"].rounds == {"1": 1}


def test_targets_against_a_plain_walk(spark):
    rng = np.random.default_rng(12)
    rows = [(str(rng.choice(["x", "y"])), k, [None, None, None, "short"][rng.integers(4)], [None, None, "long"][rng.integers(3)], f"k{rng.integers(25)}", ["m"]) for k in range(160)]
    df = spark.createDataFrame(rows, "source string, id long, reason string, late_reason string, key string, messages array<string>")
    out = {r.id: (r.reason, r.seen, r.kept) for r in jobs.fill_targets(df, {"x": 9, "y": 12}, 3.0, 4, once=True).collect()}
    import hashlib

    seen, want = set(), {}
    for k, (name, target) in enumerate({"x": 9, "y": 12}.items()):
        rank = lambda r, k=k: (hashlib.md5(f"{4 + k}:pool:{r[1]}".encode()).hexdigest(), r[1])
        pool, kept = sorted((r for r in rows if r[0] == name), key=rank)[: int(target * 3.0)], 0
        for r in pool:
            if kept == target:
                break
            reason = r[2] or ("duplicate" if r[4] in seen else r[3])
            want[r[1]] = (reason, True, reason is None)
            if reason is None:
                seen.add(r[4])
                kept += 1
    assert {k: v for k, v in out.items() if v[1]} == want


def test_guards(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "/r/x/1", "x/1"), ("a", 2, "/r/x/2", "x/2"), ("b", 3, "/s/x/3", "x/3")], "source string, id long, full string, rel string")
    right = spark.createDataFrame([("a", 2), ("b", 1)], "source string, expected long")
    wrong = spark.createDataFrame([("a", 3), ("b", 1)], "source string, expected long")
    assert readers.require_expected_counts(df, "source", right).count() == 3
    with pytest.raises(ValueError, match="a: 2 of 3"):
        readers.require_expected_counts(df, "source", wrong)
    with pytest.warns(UserWarning):
        readers.require_expected_counts(df, "source", wrong, allow=True)
    assert readers.common_path_root(df.filter("source = 'a'"), "full", "rel") == "/r/"
    with pytest.raises(ValueError, match="no common root"):
        readers.common_path_root(df, "full", "rel")
    keys = spark.createDataFrame([(1,), (9,)], "id long")
    assert isolation.first_of_each(df, "id", "source", keys).count() == 1
    with pytest.raises(Exception, match="no row for id 9"):
        isolation.first_of_each(df, "id", "source", keys, fail=True).collect()
    with pytest.raises(ValueError, match="4 rows are wanted"):
        sampling.sample_exactly(df, 4, 1, "id")
    assert [r.id for r in sampling.sample_in_order(df, 2, 1, "id").collect()] == sorted(r.id for r in sampling.sample_n(df, 2, 1, "id").collect())
    split = spark.createDataFrame([(1, "train")], "id long, half string")
    sampling.write_split_once(split, str(tmp_path / "split"))
    assert sampling.write_split_once(split.withColumn("half", F.lit("test")), str(tmp_path / "split")).first().half == "train"


def test_counter_of_a_tokenizer(spark):
    from medcorpus.functions.text import counter
    from medcorpus.operators.dialogues import trim_rounds

    df = spark.createDataFrame([(["one two three", "four"],), ([],), (None,)], "t array<string>")
    words_of = counter(lambda: lambda s: len(s.split()))
    assert [r[0] for r in df.select(words_of(F.col("t"))).collect()] == [[3, 1], [], None]
    m = spark.createDataFrame([([("user", "a b"), ("assistant", "c"), ("user", "d"), ("assistant", "e f g")],)], "m array<struct<role: string, content: string>>")
    assert [len(m.select(trim_rounds(F.col("m"), limit, words_of).alias("x")).first().x or []) for limit in (26, 27, 54, 55)] == [0, 2, 2, 4]


def test_validation_walk_against_a_loop(spark):
    import hashlib

    rng = np.random.default_rng(3)
    rows = [(f"s{s}", d, k) for s in range(12) for d in range(int(rng.integers(1, 30))) for k in range(int(rng.integers(1, 40)))]
    got = {(r.source, r.doc_id, r.chunk_no) for r in sampling.val_split_by_document(spark.createDataFrame(rows, "source string, doc_id long, chunk_no int"), 0.05, 3, cap=20).filter("split = 'val'").collect()}
    want = set()
    for s in {r[0] for r in rows}:
        sizes = {d: sum(r[:2] == (s, d) for r in rows) for d in {r[1] for r in rows if r[0] == s}}
        total = sum(sizes.values())
        need = min(20, max(1, round(total * 0.05))) if total >= 20 else 0
        for place, d in enumerate(sorted(sizes, key=lambda d: (hashlib.md5(f"3:val:{d}".encode()).hexdigest(), d))):
            if need <= 0 or place == len(sizes) - 1:
                break
            begin = 0 if sizes[d] <= max(2 * need, 3) else sizes[d] - need
            want |= {(s, d, k) for k in range(begin, sizes[d])}
            need -= sizes[d] - begin
    assert got == want and want


def test_paragraphs_of_wrapped_lines(spark):
    from medcorpus.functions.text import paragraphs

    df = spark.createDataFrame([("one \n two\n\n 中文 \n 行",)], "t string")
    assert df.select(paragraphs(F.col("t"))).first()[0] == ["one two", "中文  行"]


def test_event_windows(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:01:00' ts, 'a' event_type, 1.0D value union all select timestamp'2024-01-01 00:03:00', 'a', 2.0D union all select timestamp'2024-01-01 00:07:00', 'b', 4.0D").write.parquet(str(tmp_path / "in"))
    q = incremental.ingest_events(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double").writeStream.format("memory").queryName("event_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("event_counts").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
