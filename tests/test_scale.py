"""What must stay even or bounded, whatever the values."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from medcorpus.functions.text import rank_key
from medcorpus.operators import blooms, isolation, records, reports, resample, sampling, vectors


def frames(spark):
    n = 20_000
    x = spark.range(n)
    yield "log-normal", x.select(F.exp(F.randn(3) * 5).alias("v"), (F.col("id") % 2).alias("g"))
    yield "one outlier", x.select(F.when(F.col("id") == 7, 1e12).otherwise(F.col("id") / n).alias("v"), (F.col("id") % 2).alias("g"))
    yield "constant", x.select(F.lit(2.5).alias("v"), (F.col("id") % 2).alias("g"))
    yield "one large group", x.select(F.col("id").cast("double").alias("v"), F.when(F.col("id") < 30, F.lit(None)).otherwise(0).alias("g"))


def test_parts_of_an_order_are_even_and_statistics_exact(spark):
    for name, df in frames(spark):
        counts = df.groupBy("g", "v").agg(F.count("*").alias("_c"))
        sizes = [r["count"] for r in reports.range_parts(counts, ["g", "v"], part_rows=1000).groupBy("_part").count().collect()]
        assert max(sizes) <= 3 * max(1, sum(sizes) / len(sizes)), name
        got = {r.g: (r.median, r.first, r.last, r.n) for r in reports.order_statistics(df, ["g"], "v", part_rows=1000, median=F.floor(F.col("n") / 2), first=F.lit(0), last=F.col("n") - 1).collect()}
        want = {}
        for r in df.collect():
            want.setdefault(r.g, []).append(r.v)
        assert got == {g: (sorted(v)[len(v) // 2], min(v), max(v), len(v)) for g, v in want.items()}, name


def test_rows_are_numbered_in_order(spark):
    df = spark.createDataFrame([(k % 3 or None, (k * 7919) % 500 // 4, k) for k in range(2000)], "g int, a int, b int").repartition(6)
    got = reports.numbered(df, ["g"], ["a", "b"], "n", "size", part_rows=100).collect()
    own = {}
    for r in sorted(got, key=lambda r: (r.a, r.b)):
        own.setdefault(r.g, []).append((r.n, r["size"]))
    assert all(v == [(k + 1, len(v)) for k in range(len(v))] for v in own.values()) and len(got) == 2000


@pytest.mark.parametrize("part_values", [100, 65_536])
def test_intervals_of_many_distinct_scores(spark, part_values):
    n = 3000
    df = spark.range(n).select(F.lit("a").alias("tag"), (F.rand(5) * 2).alias("score")).union(spark.range(40).select(F.lit("b"), (F.col("id") % 2).cast("double")))
    df = df.unionByName(spark.createDataFrame([("b", None)], "tag string, score double"))
    got = {r.tag: r for r in resample.bootstrap_ci(df, ["tag"], "score", draws=1500, seed=2, part_values=part_values).collect()}
    x = np.array([r.score for r in df.filter("tag = 'a'").collect()])
    width = 2 * 1.96 * x.std() / np.sqrt(n) * 100
    assert got["a"].n == n and abs(got["a"].mean - x.mean() * 100) < 1e-6
    assert abs((got["a"].hi - got["a"].lo) / width - 1) < 0.12 and got["a"].lo < got["a"].mean < got["a"].hi
    assert got["b"].n == 40 and got["b"].mean == 50 and 25 < got["b"].lo < 45 and 55 < got["b"].hi < 75


def test_copies_of_vectors_follow_tasks_not_the_table(spark):
    copies = lambda n, tasks: 2 * n * vectors.grid_side(n, tasks)
    assert vectors.grid_side(100, 1000) == 1 and vectors.grid_side(10_000, 64) == 8
    assert copies(160_000, 64) == 2 * 160_000 * 10 and copies(40_000, 64) == 2 * 40_000 * 8
    assert vectors.grid_side(1_000_000_000, 4000) == -(-1_000_000_000 // vectors.BLOCK)
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k, rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for k in range(700)], "id long, a array<double>, b array<double>")
    one = sorted(map(tuple, vectors.retrieval_ranks(df, tasks=1).collect()))
    assert one == sorted(map(tuple, vectors.retrieval_ranks(df, block=50).collect())) and len(one) == 700


def test_rows_seen_until_a_target(spark):
    rows = [(g, k, k % 3 > 0) for g in ("a", None) for k in range(400)] + [("short", 1, True), ("none", 1, False)]
    df = spark.createDataFrame(rows, "g string, k long, ok boolean")
    got = {(r.g, r.k): (r.seen, r.kept) for r in sampling.seen_until_target(df, "g", 50, 4, "x", "k", F.col("ok"), parts=16).collect()}
    ranked = {(r.g, r.k): (r.r, r.k) for r in df.select("g", "k", rank_key(4, "x", F.col("k")).alias("r")).collect()}
    for group in ("a", None, "short", "none"):
        n = 0
        for g, k, ok in sorted((x for x in rows if x[0] == group), key=lambda x: ranked[x[:2]]):
            assert got[g, k] == (n < 50, ok and n < 50)
            n += ok


def test_sentences_of_answers(spark):
    cases = [
        ("it is left the lung here", "left lung", False), ("The yes is my answer here", "yes", False), ("this one shows a thing here", "a", True), ("Yes, it is there indeed", "Yes.", True),
        ("It is in the left lung", "Left lung", True), ("It is in the left  lung now", "left lung", True), ("There is a T2-weighted image", "t2", False), ("There is a T2 weighted image", "T2", True), ("one two\nthree four five", "two", False),
        ("one two three", "two", False), ("  one two three four ", "one", True), (" ".join(["w"] * 41), "w", False), ("it is ... not there", "...", False), (None, "a", False),
    ]
    df = spark.createDataFrame(cases, "x string, a string, ok boolean")
    got = [r.ok for r in df.select(F.coalesce(records.rewrite_ok(F.col("x"), F.col("a")), F.lit(False)).alias("ok")).collect()]
    assert got == [c[2] for c in cases]


@pytest.mark.parametrize(("n", "want"), [(100, 25), (10, 2), (14, 4), (2, 0), (0, 0)])
def test_requests_are_an_exact_share(spark, n, want):
    df = spark.range(n).select("id", F.lit("q").alias("question"), F.lit("a").alias("answer"))
    drawn = [sorted(r.id for r in records.rewrite_requests(df, "id", 0.25, seed).collect()) for seed in (1, 2)]
    assert [len(d) for d in drawn] == [want] * 2 and (n < 100 or drawn[0] != drawn[1])


def test_only_grams_that_may_be_repeated_are_moved(spark, monkeypatch):
    rng = np.random.default_rng(6)
    item = lambda: [" ".join(rng.choice(["a", "b", "c", "d", f"w{rng.integers(1 << 30)}"], size=12)) for _ in range(3)]
    rows = [(k, *item()[:1], item()) for k in range(300)] + [(300, None, ["a b"]), (301, "a b", None), (302, "a b c d", [])]
    df = spark.createDataFrame(rows, "item long, pred string, refs array<string>").repartition(5)
    stored, tables = vectors.stored, []
    monkeypatch.setattr(vectors, "stored", lambda x: tables.append(stored(x)) or tables[-1])
    grams = lambda t, n: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    own = [[set().union(*(grams(r.split(), n) for r in refs or ())) for _, _, refs in rows] for n in range(1, 5)]
    want = sum(n > 1 for sets in own for n in {g: sum(g in s for s in sets) for g in set().union(*sets)}.values())
    everywhere = {r.item: r.cider for r in vectors.cider(df).collect()}
    counts = [t.count() for t in tables if t.columns == ["gram", "df"]]
    # beside the tokens only repeated grams are stored, and no single one of two tokens goes on to three
    assert sum(counts) == want and len(counts) == 4 and [t.columns for t in tables if "df" not in t.columns] == [["item", "p", "r"]]
    single = spark.createDataFrame([([[1, 2, 3]],), ([[2, 3, 4]],)], "r array<array<long>>")
    assert vectors.repeated_grams(single, 4).count() == 3
    for hot in (0, 20):
        got = {r.item: r.cider for r in vectors.cider(df, hot=hot).collect()}
        assert got.keys() == everywhere.keys() and all(abs(got[k] - everywhere[k]) < 1e-9 for k in got)


def test_whether_a_report_has_sections_takes_no_text(spark):
    cases = [None, "", " \t\n\x0b\f\r", " a \n b\r\n", "\r\n ", "x" * 5000 + " \n"]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate((a, b) for a in cases for b in cases)], "path long, findings string, impression string")
    said, text = records.has_sections(F.col("findings"), F.col("impression")), records.report_text(F.col("findings"), F.col("impression"))
    bare = lambda x: (x or "").strip(" \t\n\x0b\f\r")
    for r in df.select("*", said.alias("said"), text.alias("text")).collect():
        want = "\n".join(f"{k}: {bare(x)}" for k, x in (("Findings", r.findings), ("Impression", r.impression)) if bare(x)) or None
        assert r.text == want and r.said == (want is not None)
    rows, skipped = records.report_rows(df, "path", 42)
    assert skipped.first().n_skipped == 9 and rows.count() == 27
    # white space around long texts is cut without a search in all of them
    assert "regexp_replace" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_contamination_holds_few_texts_at_a_time():
    """A batch of many texts takes little more memory in a task than one of few."""
    import tracemalloc

    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", dtype=np.uint8)
    texts = ["".join(map(chr, letters[rng.integers(0, 26, 400)])) for _ in range(12_000)]
    known = isolation.window_hashes(isolation._codes(texts[7][:20] + texts[11_000][100:120]), 20)[[0, 20]]
    bits = np.zeros(1 << 18, dtype=np.uint8)
    index = blooms.Bloom(bits)
    for h in known.tolist():
        for k in range(blooms.PLACES):
            place = ((h & int(index.mask)) + k * ((h >> 32) & int(index.mask) | 1)) & int(index.mask)
            bits[place >> 3] |= 1 << (place & 7)
    none = blooms.Bloom(np.zeros(1 << 15, dtype=np.uint8))

    def peak(n):
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["d"] * n), pa.array([0] * n, pa.int64()), pa.array(texts[:n])], names=["k", "d", "h", "t"])
        tracemalloc.start()
        found = [r for out in isolation._candidates([batch], index, none, 20) for r in out.to_pylist()]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, [(r["key"], r["n_windows"], r["w"]) for r in found]

    few, many = peak(400), peak(12_000)
    assert few[1] == [(7, 381, texts[7][:20])] and many[1] == [*few[1], (11_000, 381, texts[11_000][100:120])]
    assert many[0] < 1.5 * few[0]


def test_blocks_of_captions_ask_once_for_a_gram(spark, monkeypatch):
    rng = np.random.default_rng(8)
    text = lambda: " ".join(rng.choice(list("abcdefgh") + [f"w{rng.integers(1 << 30)}"], size=9))
    rows = [(k // 2, text(), [text(), text()]) for k in range(200)] + [(None, "a b c d e", ["a b c d e f", "b c d"]), (500, None, None), (501, "", [])]
    df = spark.createDataFrame(rows, "item long, pred string, refs array<string>").repartition(3)
    want = sorted(map(tuple, vectors.cider(df, sigma=6.0).select("item", F.round("cider", 9)).collect()), key=repr)
    stored, tables = vectors.stored, []
    monkeypatch.setattr(vectors, "stored", lambda x: tables.append(stored(x)) or tables[-1])
    got = sorted(map(tuple, vectors.cider(df, sigma=6.0, hot=0).select("item", F.round("cider", 9)).collect()), key=repr)
    # items without a number or with the same one, too
    assert got == want and len(got) == len(rows)
    answers = [t for t in tables if "block" in t.columns]
    assert len(answers) == 4
    for n, table in enumerate(answers, 1):
        # an answer is a number for each gram that a run of rows asked for, whatever rows and texts have it
        runs = {}
        for r in table.collect():
            runs.setdefault((r.file, r.block, r.first, r.last), []).append(len(vectors._unpacked(r.df)))
        assert all(r.last - r.first < vectors.BLOCK_ROWS and r.last // vectors.BLOCK_ROWS == r.block for r in table.collect())
        assert n > 1 or all(sum(sizes) <= 40 for sizes in runs.values())


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_numbers_packed_by_their_bytes(n):
    x = np.random.default_rng(n).integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2)
    assert (vectors._unpacked(vectors._packed(x)) == x).all() and len(vectors._packed(x)) == 8 * n


def test_shuffle_files_of_a_stored_table_go_with_its_query(spark):
    from medcorpus.storage import short_lived_shuffles, stored

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with short_lived_shuffles(spark):
        x = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before and x.agg(F.sum("count")).first()[0] == 1000
