"""Licence scans: notices in words the model has not seen, and ordinary text."""

import math
import random

import numpy as np

from medcorpus.llm.op05_licences import CONFIRM, CUES, FAMILIES, HELD_OTHERS, SPDX, TEMPLATES, _find, examples, fit_licences, grams, licence_spans, op5_licences, scan_licences, train_licences, variants

NOTICES = {
    "Released under the MIT License.": "mit",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Licensed under CC BY 4.0": "cc-by",
    "Licensed under the Apache License, Version 2.0 (the \"License\");": "apache",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "This library is distributed under the terms of the GNU Lesser General Public License": "lgpl",
    "(c) Example Ltd. All rights reserved.": "proprietary",
    "Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
}


def ordinary():
    rng = random.Random(8)
    words = "the of and that under in version work use this river public free to any person may terms source general".split()
    return [[rng.choice(words) for _ in range(rng.randrange(3, 40))] for _ in range(500)]


def test_notices():
    model = fit_licences(ordinary())
    for text, family in NOTICES.items():
        assert [f for _, _, f in licence_spans("a b c\n" + text + "\nd", model)] == [family], text
        assert licence_spans("a b c\n" + text + "\nd", model)[0][:2] == (6, 6 + len(text))
    for text in ("the permission of the river", "my rights and the public work", "version 2.0 of the general terms", "", "mit dem Fluss und der Stadt", "cc"):
        assert licence_spans(text, model) == [], text
    assert [f for _, _, f in licence_spans("This file is licensed under the Fantasia Software License version 9", model)] == ["unknown"]


def test_rows(spark):
    rows = [(k, " ".join(p), "z") for k, p in enumerate(ordinary())] + [(900, "x\n" + "Released under the MIT License.", "z"), (901, None, "z"), (902, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, families string")
    got = {r.doc_id: r for r in scan_licences(df, train_licences(df)).collect()}
    assert len(got) == len(rows) and got[900].spans == "mit:2:33" and got[901].n_licences == 0
    assert sum(r.n_licences for r in got.values()) == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert scan_licences(empty, train_licences(empty)).count() == 0


def test_templates_and_identifiers():
    model = fit_licences(ordinary())
    for family, texts in TEMPLATES.items():
        for text in (*texts, *(f"SPDX-License-Identifier: {i.upper()}" for i in SPDX.get(family, ())), *(i.upper() for i in SPDX.get(family, ()) if "-" in i)):
            assert [f for _, _, f in licence_spans("a b c\n" + text + "\nd", model)] == [family], text
    for text in ("mit dem Fluss", "the public domain of the river", "a free and open work", "this is free for any purpose", "in compliance with the terms"):
        assert licence_spans(text, model) == [], text


def test_unlicense_rows(spark):
    notice = "This is free and unencumbered software released into the public domain."
    rows = [(k, " ".join(p)) for k, p in enumerate(ordinary())] + [(900 + k, f"x {k}\n{notice}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.families for r in scan_licences(df, train_licences(df)).collect()}
    assert {got[900 + k] for k in range(30)} == {"unlicense"} and not any(got[k] for k in range(500))


def test_recall_false_alarms_and_calibration():
    model, rng = fit_licences(ordinary()), random.Random(99)
    other = sorted({w for p in ordinary() for w in p})
    found = [(k + 1, model.probabilities(own), own) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f] for own in variants(t, other, rng, 20)]
    # a dropped word can turn one family's notice into another's ("affero", "lesser", a "by"), so not all can be told apart
    assert sum(int(np.argmax(p)) == k for k, p, _ in found) > 0.9 * len(found)
    unknown = [model.probabilities(own) for t in HELD_OTHERS for own in variants(t, other, rng, 50)]
    assert sum(p[0] < 0.5 for p in unknown) > 0.8 * len(unknown) and sum(p[-1] >= 0.5 for p in unknown) > 0.6 * len(unknown)
    cued = []
    for p in ordinary():
        own = list(p)
        for _ in range(3):
            own.insert(rng.randrange(len(own) + 1), rng.choice(CUES))
        cued.append(own)
    assert sum(model.family(own) is not None for own in cued) < 0.02 * len(cued)
    # calibration: of paragraphs with a top probability of about p, about p are right
    new = examples(ordinary()[:250], random.Random(7))
    top = [(float(q.max()), int(np.argmax(q)) == k) for own, k in new if (q := model.probabilities(own)) is not None]
    error = sum(abs(np.mean([r for _, r in part]) - np.mean([p for p, _ in part])) * len(part) for a in np.arange(0, 1, 0.1) if (part := [x for x in top if a <= x[0] < a + 0.1 or x[0] == a + 0.1 == 1.0])) / len(top)
    assert error < 0.08, error


def test_probabilities_by_hand():
    model = fit_licences(ordinary())
    own = grams(_find("released under the mit license by the river"))
    z = [float(model.bias[k]) + sum(float(model.weights[model.index[g]][k]) for g in own if g in model.index) for k in range(len(FAMILIES) + 2)]
    e = [math.exp(x / model.temperature) for x in z]
    assert np.allclose(model.probabilities(own), [x / sum(e) for x in e], atol=1e-4)


def test_wrapped_notices():
    model = fit_licences(ordinary())
    text = "first line\nPermission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and more\nlast line"
    spans = licence_spans(text, model)
    assert [f for _, _, f in spans] == ["mit"] and text[spans[0][0] : spans[0][1]].startswith("Permission is") and "person obtaining" in text[: spans[0][1]]
    broken = text.replace("any\nperson", "any\n\nperson")
    assert all(b - a < 60 for a, b, _ in licence_spans(broken, model))


def by_definition(text, model):
    """Spans from the templates, the weights and the docstring's rules, with nothing of the operator's own counting."""
    import re

    find = lambda t: re.findall(r"[a-z0-9]+(?:[-.][a-z0-9]+)*", t.lower())

    def ngrams(words):
        out = set()
        for own in (words, [p for w in words for p in w.split("-")]):
            out |= {" ".join(own[k : k + n]) for n in (1, 2) for k in range(len(own) - n + 1)}
        return out

    templates = {f: [ngrams(find(t)) for t in TEMPLATES[f]] for f in FAMILIES}
    only = {f: set().union(*templates[f]) - set().union(*(t for g in FAMILIES if g != f for t in templates[g])) for f in FAMILIES}
    named = {f: {x for i in SPDX.get(f, ()) for x in ([f"spdx-license-identifier {i}"] + [i] * ("-" in i))} for f in FAMILIES}

    def share(own, f):
        return 1.0 if own & named[f] else max(len(t & own) / len(t) if own & t & only[f] else 0.0 for t in templates[f])

    def size(own, f):
        return 1000 if own & named[f] else max((len(t) for t in templates[f] if t <= own), default=0)

    def judged(own):
        if not any(g in model.index for g in own):
            return None, 0.0
        z = [float(model.bias[c]) + sum(float(model.weights[model.index[g]][c]) for g in own if g in model.index) for c in range(len(FAMILIES) + 2)]
        e = [math.exp((x - max(z)) / model.temperature) for x in z]
        p = [x / sum(e) for x in e]
        best = max(range(len(FAMILIES)), key=lambda k: (p[k + 1], -k))
        held = share(own, FAMILIES[best])
        if p[0] >= 0.5 and held < CONFIRM:
            return None, held
        if p[0] < 0.5:
            whole, _, k = max((size(own, f), p[k + 1], k) for k, f in enumerate(FAMILIES))
            if whole:
                return FAMILIES[k], 1.0
        if p[best + 1] >= model.sure and held >= CONFIRM:
            return FAMILIES[best], held
        return ("unknown", held) if p[0] < 0.5 and (held >= 0.5 or p[-1] >= 0.5) else (None, held)

    top = lambda own: max(len(t & own) / len(t) for f in FAMILIES for t in templates[f])
    lines = [(m.start(), m.end(), find(m[0])) for m in re.finditer(r"(?m)^.*$", text)]
    alone = [judged(ngrams(w)) for *_, w in lines]
    joined = lambda a, b: ngrams([w for line in lines[a : b + 1] for w in line[2]])
    out, k = [], 0
    while k < len(lines):
        family, held = alone[k]
        best, e = None, k
        while lines[k][2] and e + 1 < len(lines) and lines[e + 1][2] and alone[e + 1][0] in (None, "unknown") and 0 < top(joined(k, e)) < top(joined(k, e + 1)):
            e += 1
            if top(joined(k, e)) >= 0.2:
                said, share_ = judged(joined(k, e))
                if said and (best is None or (said != "unknown", share_) > best[2]):
                    best = (e, said, (said != "unknown", share_))
        if best and best[2] > (family not in (None, "unknown"), held if family else -1.0):
            begin = k
            while begin < best[0] and top(joined(begin + 1, best[0])) >= top(joined(begin, best[0])):
                begin += 1
            out.append((lines[begin][0], lines[best[0]][1], best[1]))
            k = best[0] + 1
            continue
        if family:
            out.append((*lines[k][:2], family))
        k += 1
    return out


def wrapped(text, n):
    words = text.split()
    return "\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n))


def test_spans_by_definition():
    model, rng = fit_licences(ordinary()), random.Random(21)
    pool = [*NOTICES, *(t for f in FAMILIES for t in TEMPLATES[f]), *HELD_OTHERS, "SPDX-License-Identifier: MIT", "cc-by-sa-4.0", "mit"]
    checked = 0
    for _ in range(150):
        parts = [rng.choice(["", "plain words of the river", " ".join(rng.choice(ordinary())[:12]), wrapped(rng.choice(pool), rng.randrange(2, 9)), rng.choice(pool)]) for _ in range(6)]
        text = "\n".join(parts)
        want = by_definition(text, model)
        assert licence_spans(text, model) == want, text
        checked += len(want)
    assert checked > 100


def test_notices_wrapped_over_many_lines():
    model = fit_licences(ordinary())
    full = {"mit": TEMPLATES["mit"][2], "isc": TEMPLATES["isc"][0], "bsd": TEMPLATES["bsd"][0], "unlicense": TEMPLATES["unlicense"][0]}
    for family, notice in full.items():
        for n in (2, 3, 4, 6):
            text = f"an ordinary line\n{wrapped(notice, n)}\n\nlast"
            spans = licence_spans(text, model)
            assert [f for *_, f in spans] == [family], (family, n, spans)
            begin, end = text.index(notice.split()[0] + " "), len(text) - 6
            assert spans[0][0] <= begin + 20 and spans[0][1] >= end - 25, (family, n, spans)


def test_families_that_tie():
    model = fit_licences(ordinary())
    both = "released under the mit license and licensed under the apache license version 2.0"
    assert [f for *_, f in licence_spans(both, model)] == ["apache"] == [f for *_, f in by_definition(both, model)]
    two = "SPDX-License-Identifier: MIT SPDX-License-Identifier: ISC"
    assert licence_spans(two, model) == by_definition(two, model) and len(licence_spans(two, model)) == 1


def test_registered_query(spark, tmp_path):
    lines = [" ".join(p) for p in ordinary()]
    long = "\n".join(lines * 40)
    rows = [(k, t, 0) for k, t in enumerate(lines)] + [(900, long + "\nLicensed under the Apache License, Version 2.0.", 1), (901, None, 0), (902, "All rights reserved.", 0), (902, "All rights reserved.", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, families int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op5_licences(spark, str(tmp_path)).filter("n_licences > 0").collect()]
    # the same by a plain loop over the registered parts
    model = train_licences(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    want = []
    for d, t, _ in rows:
        spans = licence_spans(t or "", model)
        if spans:
            want.append((d, len(spans), ",".join(sorted({f for *_, f in spans})), ",".join(f"{f}:{a}:{b}" for a, b, f in spans)))
    assert sorted(got) == sorted(want) and [g[2] for g in sorted(got)] == ["apache", "proprietary", "proprietary"] and 0 < CONFIRM < 1
