"""Edit matching against plain dynamic programming."""

import random

from medcorpus.llm.op06_decontam import Matcher, Pattern, drop_contaminated, find_contamination, op6_decontam, plain


def distance_within(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return min(row)


def test_myers_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        assert Pattern(item).best_end(text)[0] == distance_within(item, text)


def test_all_within_budget_are_found(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoin shrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 40)))) for k in range(12)]
    docs = []
    for d in range(150):
        own = list(rng.choice(items)[1])
        for _ in range(rng.randrange(0, 16)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz", "\n"])
        docs.append((d, " ".join(rng.choice(words) for _ in range(20)) + " " + "".join(own).upper() + " " + " ".join(rng.choice(words) for _ in range(20))))
    items += [(50, ""), (51, None), (52, "short")]
    docs += [(900, None), (901, ""), (902, "a Short one")]
    want = set()
    for d, t in docs:
        for k, i in items:
            i = plain(i or "").strip()
            if i and t and distance_within(i, plain(t)) <= (int(len(i) * 0.08) if len(i) >= 30 else 0):
                want.add((d, k, distance_within(i, plain(t))))
    got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=900).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want) and len(want) > 50
    texts, item_of = dict(docs), dict(items)
    for r in got:
        span = plain(texts[r.doc_id])[r.start : r.end]
        assert distance_within(plain(item_of[r.item_id]).strip(), span) == r.distance


def test_no_items():
    assert Matcher([], 0.1, 30).find("text") == []


def test_every_occurrence():
    rng = random.Random(4)
    item = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(9))
    changed = item[:20] + "X" + item[21:]
    text = f"first {item} then {changed} and {item} end"
    matcher = Matcher([(1, item)], 0.08, 30)
    assert matcher.find(text) == [(1, 6, 6 + len(item), 0)]
    found = sorted(matcher.find(text, every=True), key=lambda m: m[1])
    assert [(m[3], text[m[1] : m[2]]) for m in found] == [(0, item), (1, changed), (0, item)]


def test_registered_query_and_edge_cases(spark, tmp_path):
    item = "the quick brown fox jumps over the lazy dog by the river bank"
    long = "word " * 200_000
    rows = [(1, f"a {item} b"), (1, f"a {item} b"), (2, long + item.upper()), (3, long), (4, None), (5, ""), (None, item)]
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, item_id long, start long, distance int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item), (7, item), (8, "an item that is nowhere to be found in any of these texts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in op6_decontam(spark, str(tmp_path)).collect()), key=str)
    want = [(d, 7, a, a + len(item), 0) for d, a in ((1, 2), (1, 2), (2, len(long)), (None, 0)) for _ in range(2)]
    assert got == sorted(want, key=str)
    items = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    for block in (4_000_000, 50):
        left = drop_contaminated(docs, items, block_chars=block)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5]
    assert find_contamination(docs.limit(0), items).count() == 0 and find_contamination(docs, items.limit(0)).count() == 0
