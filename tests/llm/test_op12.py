"""The audit against filters applied one after another."""

import random
import re
from itertools import permutations

from medcorpus.llm.op12_audit import audit_filters, counted_masks


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    rows = []
    for d, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = d is not None and any(o is not None and o < d and (u or "") == t for o, u, _ in docs)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller}
        rows.append((lang or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out, shapley = [], {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                only = sum(r[1] == {f} for r in rows if r[0] == part)
                out.append((part, "".join(order), step, len(left), len(removed), sum(f in r[1] for r in gone), only, sum(r[2] for r in removed), sum(r[3] for r in removed)))
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
                gone += removed
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def got(spark, docs, labels, parts=3):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, lang string, mask string").repartition(parts)
    ls = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in audit_filters(counted_masks(d, ls)).collect())


def test_same_as_filtering(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        n = rng.choice([0, 3, 150, 199, 200, 201, 260])
        vocabulary = rng.choice([3, 100, 400])
        texts.append(" ".join(rng.choice(["w", "W", "Word", "É"]) + str(rng.randrange(vocabulary)) + rng.choice(["", "", "", "#", "\t|"]) * (rng.random() < 0.05) for _ in range(n)))
    texts += [None, "", "  ", "A", "a" * 33 + "B", "a" * 97 + "BCD", "a" * 96 + "BCDE", "\n".join(str(k) for k in range(200)), "word " * 100_000]
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(150)]
    docs += [(5, texts[0], "en"), (5, texts[0], "en"), (None, texts[1], "de"), (None, texts[1], "de"), (-3, texts[2], "fr"), (900, "only here", "fr")]
    labels = [(k, rng.choice([0, 1]), rng.choice([0, 1])) for k in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (6, None, None)]
    assert got(spark, docs, labels) == brute(docs, labels)


def test_repeated_smallest_ids_stay(spark):
    docs = [(1, "same", "en")] * 3 + [(2, "same", "en"), (None, "same", "en")]
    rows = [r for r in got(spark, docs, []) if r[1] == "EABCD" and r[2] == 1]
    assert [r[3:5] for r in rows] == [(4, 1)]


def test_empty_tables(spark):
    assert got(spark, [], []) == []


def test_other_filters(spark):
    counts = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 2, 1), ("p", 2, 4, 0, 4)], "part string, mask int, n long, good long, toxic long")
    rows = {r.filter_order + str(r.step): tuple(r)[3:] for r in audit_filters(counts, "XY").collect()}
    assert rows == {"XY1": (9, 2, 0, 0, 2, 1, 2), "XY2": (5, 4, 2, 4, 0, 4, 10), "YX1": (5, 6, 0, 4, 2, 5, 10), "YX2": (5, 0, 2, 0, 0, 0, 2)}
