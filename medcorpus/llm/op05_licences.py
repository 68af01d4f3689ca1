"""Licence scans by a trained paragraph classifier.

A paragraph is a line, or several lines in a row that only together make a notice (a wrapped notice): lines are joined while each raises the share
of some template that is held, however many there are, and those in front without a part in it are left out; blank lines end it. It is
a sparse set of word 1-grams and 2-grams, of its words as written and with hyphens split. A multinomial logistic
regression over the n-grams of templates and SPDX identifiers has a class for no licence, one for each family, and ``unknown``.
It is trained here on variants of the families' templates (words dropped, ordinary words put in), on variants of the notices of
``OTHERS`` (licences that have no family) for ``unknown``, and for no licence on ordinary paragraphs of a bounded sample of
documents, also with single words of the templates put in. Its probabilities are calibrated by a temperature on variants it was
not trained on; what probability a family needs is the least, from ``SURE`` up, at which at most ``WRONG`` of the variants of the
notices of ``HELD_OTHERS``, which it has never seen, are taken for a family.

A predicted family is confirmed only if the paragraph holds at least ``CONFIRM`` of the n-grams of one of the family's templates, or
one of its identifiers; otherwise it is ``unknown``. A licence-like paragraph that holds a template whole is of the family of
the largest such template. Every paragraph is scored whose n-grams could together outweigh "no licence", or that holds enough of a template;
no word list is asked first.

The model is a table of weights, learnt on the driver; the scan is one pass over the documents without a shuffle.

Cases: a null or empty text has no licences; a paragraph with no n-gram of the templates is never a licence; very long texts
are scanned whole, line by line; repeated rows are scanned once each; families that tie are told apart by the size of the template held,
then the probability, then the later name; without ordinary paragraphs the model is trained on variants and made-up blanks; an
empty table gives no rows; other columns are never read. Places are code points, the end exclusive.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medcorpus.llm.common import sliced, small_batches, table

#: What licence notices of each family say.
TEMPLATES = {
    "agpl": ("licensed under the gnu affero general public license version 3", "agpl-3.0 license", "under the terms of the gnu affero general public license"),
    "apache": ("licensed under the apache license version 2.0", "apache license 2.0", "apache-2.0 license", "you may not use this file except in compliance with the license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "distributed under the bsd 3-clause license", "released under the bsd license", "bsd 2-clause license"),
    "cc0": ("dedicated to the public domain under cc0 1.0", "creative commons zero public domain dedication", "released under cc0"),
    "cc-by": ("licensed under cc by 4.0", "creative commons attribution 4.0 international license", "this work is licensed under a creative commons attribution license"),
    "cc-by-nc": ("licensed under cc by-nc 4.0", "creative commons attribution-noncommercial 4.0 international license", "licensed under a creative commons attribution noncommercial license", "cc by-nc-sa 4.0", "cc by-nc-nd 4.0"),
    "cc-by-sa": ("licensed under cc by-sa 4.0", "creative commons attribution-sharealike 4.0 international license", "licensed under a creative commons attribution share-alike license"),
    "gpl": ("this work is licensed under the gnu general public license version 3", "gnu general public license version 2 or later", "under the terms of the gnu general public license", "gpl-3.0 license", "licensed under the gpl"),
    "isc": ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "released under the isc license"),
    "lgpl": ("gnu lesser general public license version 2.1", "under the terms of the gnu lesser general public license", "lgpl-2.1 license"),
    "mit": ("released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    "mpl": ("subject to the terms of the mozilla public license version 2.0", "mozilla public license 2.0"),
    "proprietary": ("all rights reserved", "copyright all rights reserved no part may be reproduced without permission", "proprietary and confidential unauthorized copying is prohibited"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "released under the unlicense"),
}
#: SPDX identifiers, as one token; those without a hyphen count only after IDENTIFIER, since they may be plain words.
SPDX = {
    "agpl": ("agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"),
    "apache": ("apache-2.0", "apache-1.1"),
    "bsd": ("bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd"),
    "cc0": ("cc0-1.0",),
    "cc-by": ("cc-by-4.0", "cc-by-3.0"),
    "cc-by-nc": ("cc-by-nc-4.0", "cc-by-nc-3.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0"),
    "cc-by-sa": ("cc-by-sa-4.0", "cc-by-sa-3.0"),
    "gpl": ("gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later"),
    "isc": ("isc",),
    "lgpl": ("lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later"),
    "mit": ("mit", "mit-0"),
    "mpl": ("mpl-1.1", "mpl-2.0"),
    "unlicense": ("unlicense",),
}
IDENTIFIER = "spdx-license-identifier"
#: Notices of licences that have no family; ``unknown`` is learnt from the first and tried on the second.
OTHERS = (
    "licensed under the eclipse public license 2.0", "made available under the terms of the eclipse public license", "distributed under the boost software license version 1.0", "licensed under the artistic license 2.0",
    "released under the zlib license", "licensed under the academic free license version 3.0", "this font software is licensed under the sil open font license version 1.1", "licensed under the microsoft public license",
    "licensed under the postgresql license", "available under the vim license", "licensed under the common development and distribution license", "released under the terms of the python software foundation license",
)
HELD_OTHERS = ("licensed under the european union public licence 1.2", "released under the open software license 3.0", "made available under the open database license", "distributed under the terms of the cecill license")
UNKNOWN = "unknown"
#: The share of a template's n-grams that makes a licence-like paragraph one of an unknown licence, and joined lines worth a look.
LIKE, PART = 0.5, 0.2
FAMILIES = tuple(TEMPLATES)
SURE, CONFIRM, WRONG = 0.8, 0.6, 0.02
#: Documents whose paragraphs are the ordinary ones, and paragraphs kept of them, at most; variants of each template.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, VARIANTS = 2_000, 4_000, 24
_find = re.compile(r"[a-z0-9]+(?:[-.][a-z0-9]+)*").findall


def grams(words: list[str]) -> set[str]:
    """1-grams and 2-grams of the words, and of the words with hyphens split."""
    own = {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}
    parts = [p for w in words for p in w.split("-")]
    if len(parts) > len(words):
        own |= {*parts, *(f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False))}
    return own


def identifiers(family: str) -> list[str]:
    """The texts that name a family by an SPDX identifier alone."""
    return [x for i in SPDX.get(family, ()) for x in ([f"{IDENTIFIER} {i}", i] if "-" in i else [f"{IDENTIFIER} {i}"])]


TEMPLATE_GRAMS = [[frozenset(grams(_find(t))) for t in TEMPLATES[f]] for f in FAMILIES]
#: The n-grams that only this family's templates have.
OWN_GRAMS = [frozenset().union(*texts) - frozenset().union(*(t for other in TEMPLATE_GRAMS if other is not texts for t in other)) for texts in TEMPLATE_GRAMS]


#: The templates that have an n-gram, by number, and the templates' sizes; identifiers, each of which is held whole or not.
SIZES = [len(t) for texts in TEMPLATE_GRAMS for t in texts]
TEMPLATES_OF: dict[str, list[int]] = {}
for _k, _t in enumerate(t for texts in TEMPLATE_GRAMS for t in texts):
    for _g in _t:
        TEMPLATES_OF.setdefault(_g, []).append(_k)
IDENTIFIERS = frozenset(i for f in TEMPLATES for i in identifiers(f))
_OTHER_GRAMS = [frozenset(grams(_find(t))) for t in (*OTHERS, *HELD_OTHERS)]
#: 1-grams that tell a licence notice from other text, and so are put into ordinary paragraphs one at a time.
CUES = sorted({g for texts in TEMPLATE_GRAMS for t in texts for g in t if g.isalpha() and len(g) > 3})


def held_share(own: set[str], family: int) -> float:
    """The largest share of a template that the n-grams hold, with one that only its family has; 1 if they hold an identifier."""
    if any(i in own for i in identifiers(FAMILIES[family])):
        return 1.0
    return max(0.0 if own.isdisjoint(t & OWN_GRAMS[family]) else len(t & own) / len(t) for t in TEMPLATE_GRAMS[family])


def whole_size(own: set[str], family: int) -> int:
    """The n-grams of the largest template of the family that is held whole; an identifier is more than any template."""
    if any(i in own for i in identifiers(FAMILIES[family])):
        return 1000
    return max((len(t) for t in TEMPLATE_GRAMS[family] if t <= own), default=0)


def template_hits(own: set[str]) -> Counter:
    """How many of each template's n-grams are held."""
    return Counter(k for g in own for k in TEMPLATES_OF.get(g, ()))


def top_share(own: set[str]) -> float:
    """The largest share of any template that is held."""
    return max((n / SIZES[k] for k, n in template_hits(own).items()), default=0.0)


@dataclass
class LicenceModel:
    """Weights of n-grams for no licence, for each family, and for ``unknown``."""

    index: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    sure: float = SURE

    def __post_init__(self):
        #: What an n-gram can do at most for a class against no licence.
        self.gains = dict(zip(self.index, (self.weights[:, 1:].max(axis=1) - self.weights[:, 0]).clip(0).tolist(), strict=True))
        self.head_start = float(self.bias[1:].max() - self.bias[0])

    def may_be_notice(self, own: set[str]) -> bool:
        """False only if no licence is more likely than all else, and no template or identifier is held: then the paragraph is none."""
        gains, n_other = self.gains, len(self.bias) - 1
        most = self.head_start + sum(gains[g] for g in own if g in gains)
        return most > -self.temperature * math.log(n_other) or not own.isdisjoint(IDENTIFIERS) or top_share(own) >= CONFIRM

    def probabilities(self, own: set[str]) -> np.ndarray:
        z = (self.bias + self.weights[[self.index[g] for g in own if g in self.index]].sum(axis=0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def judged(self, words: list[str]) -> tuple[str | None, float]:
        """The family that a paragraph names, ``unknown``, or None; and how much of a family's template it holds."""
        return self.judged_grams(grams(words))

    def judged_grams(self, own: set[str]) -> tuple[str | None, float]:
        if own.isdisjoint(self.index) or not self.may_be_notice(own):
            return None, 0.0
        p = self.probabilities(own)
        named = p[1:-1]
        best = int(np.argmax(named))
        held = held_share(own, best)
        if p[0] >= 0.5 and held < CONFIRM:
            return None, held
        whole = max((whole_size(own, k), named[k], k) for k in range(len(FAMILIES))) if p[0] < 0.5 else (0, 0, 0)
        if whole[0]:
            return FAMILIES[whole[2]], 1.0
        if named[best] >= self.sure and held >= CONFIRM:
            return FAMILIES[best], held
        return UNKNOWN if p[0] < 0.5 and (held >= LIKE or p[-1] >= 0.5) else None, held

    def family(self, words: list[str]) -> str | None:
        return self.judged(words)[0]


def variants(text: str, other: list[str], rng: random.Random, n: int = VARIANTS) -> list[set[str]]:
    """The n-grams of a notice as it is, and of others with words dropped and ordinary words around them."""
    words, out = _find(text), []
    for v in range(n):
        own = [w for w in words if rng.random() > (0.12 if v and len(words) > 4 else 0)]
        pad = [rng.choice(other) for _ in range(rng.randrange(0, 12) if v else 0)]
        cut = rng.randrange(len(pad) + 1)
        out.append(grams(pad[:cut] + own + pad[cut:]))
    return out


def ordinary_words(ordinary: list[list[str]]) -> list[str]:
    return sorted({w for p in ordinary for w in p}) or ["blank"]


def examples(ordinary: list[list[str]], rng: random.Random) -> list[tuple[set[str], int]]:
    """n-grams and class of the training paragraphs."""
    other = ordinary_words(ordinary)
    rows = [(grams(p), 0) for p in ordinary] + [(set(), 0)]
    for p in ordinary[:1000] or [["blank"] * 5]:
        own = list(p)
        for _ in range(rng.randrange(1, 4)):
            own.insert(rng.randrange(len(own) + 1), rng.choice(CUES))
        rows.append((grams(own), 0))
    for k, family in enumerate(FAMILIES):
        rows += [(own, k + 1) for text in (*TEMPLATES[family], *identifiers(family)) for own in variants(text, other, rng)]
    return rows + [(own, len(FAMILIES) + 1) for text in OTHERS for own in variants(text, other, rng)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_licences(ordinary: list[list[str]], seed: int = 13) -> LicenceModel:
    """The model of notices against ordinary paragraphs (lists of words)."""
    rng = random.Random(seed)
    rows = examples(ordinary, rng)
    texts = [*(t for f in FAMILIES for t in (*TEMPLATES[f], *identifiers(f))), *OTHERS]
    index = {g: k for k, g in enumerate(sorted({g for t in texts for g in grams(_find(t))}))}
    x = np.zeros((len(rows), len(index)), dtype=np.float32)
    for k, (own, _) in enumerate(rows):
        x[k, [index[g] for g in own if g in index]] = 1
    y = np.array([r[1] for r in rows])
    held, classes = np.arange(len(rows)) % 5 == 0, len(FAMILIES) + 2
    target = np.eye(classes, dtype=np.float32)[y]
    weight = (1 / np.bincount(y, minlength=classes).clip(1))[y][:, None].astype(np.float32)
    weight[y == 0] *= len(FAMILIES)
    w, b = np.zeros((len(index), classes), dtype=np.float32), np.zeros(classes, dtype=np.float32)
    train, moved, moved_b = ~held, np.zeros_like(w), np.zeros_like(b)
    seen, wanted, weighs = x[train], target[train], weight[train]
    for _ in range(200):
        error = (softmax(seen @ w + b) - wanted) * weighs
        moved = 0.9 * moved - 0.25 * (seen.T @ error + 2e-4 * w)
        moved_b = 0.9 * moved_b - 0.25 * error.sum(axis=0)
        w, b = w + moved, b + moved_b
    z = x[held] @ w + b
    loss = {t: -float(np.log(softmax(z / t)[np.arange(len(z)), y[held]].clip(1e-9)).mean()) for t in np.geomspace(0.25, 4, 33).tolist()}
    model = LicenceModel(index, w, b, min(loss, key=loss.get))
    other = ordinary_words(ordinary)
    never = [own for text in HELD_OTHERS for own in variants(text, other, rng, 4 * VARIANTS)]
    taken = []
    for own in never:
        p = model.probabilities(own)[1:-1]
        if held_share(own, int(np.argmax(p))) >= CONFIRM:
            taken.append(float(p.max()))
    taken.sort(reverse=True)
    allowed = int(WRONG * len(never))
    if len(taken) > allowed:
        model.sure = max(SURE, min(0.99, float(np.nextafter(taken[allowed], 1))))
    return model


def is_ordinary(words: list[str]) -> bool:
    """Whether a paragraph can stand for ordinary text: it is like no template and no notice."""
    own = grams(words)
    if own.isdisjoint(CUES):
        return True
    return all(held_share(own, k) < LIKE for k in range(len(FAMILIES))) and all(len(t & own) < LIKE * len(t) for t in _OTHER_GRAMS)


def _paragraphs(batches):
    for batch in sliced(batches):
        found = [line for text in batch.column(0).to_pylist() for line in (text or "").split("\n") if is_ordinary(_find(line.lower()))]
        yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.string())], names=["line"])


def train_licences(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_paragraphs: int = SAMPLE_PARAGRAPHS, id_col: str = "doc_id", text_col: str = "text") -> LicenceModel:
    """The model against ordinary paragraphs, of the documents with the smallest hashes of their ids."""
    small_batches(docs.sparkSession)
    ids = docs.select(F.col(id_col).alias("doc_id")).filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # at most sample_docs ids are broadcast
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id").select("text")
    lines = texts.mapInArrow(_paragraphs, "line string").distinct().orderBy(F.xxhash64("line"), "line").limit(sample_paragraphs)
    return fit_licences([_find(r["line"].lower()) for r in lines.collect()])


def _wrapped(lines: list[tuple], k: int, model: LicenceModel) -> tuple[int, int, str, tuple[bool, float]] | None:
    """First and last line, family and worth of the best notice that begins by line k and takes more lines; None if there is none."""
    hits = template_hits(lines[k][4])
    share = max((n / SIZES[t] for t, n in hits.items()), default=0.0)
    own, before, best = set(lines[k][4]), lines[k][2], None
    for e in range(k + 1, len(lines)):
        words, family = lines[e][2:4]
        if not share or not words or family not in (None, UNKNOWN):
            break
        more = (lines[e][4] | grams([before[-1], words[0]])) - own
        hits.update(template_hits(more))
        now = max(n / SIZES[t] for t, n in hits.items())
        if now <= share:
            break
        own, before, share = own | more, words, now
        if share >= PART:
            said, held = model.judged_grams(own)
            if said and (best is None or (said != UNKNOWN, held) > best[3]):
                best = (k, e, said, (said != UNKNOWN, held))
    if best is None:
        return None
    # lines in front that hold nothing of the template that is held most
    joined = lambda a: grams([w for line in lines[a : best[1] + 1] for w in line[2]])
    begin = k
    while begin < best[1] and top_share(joined(begin + 1)) >= top_share(joined(begin)):
        begin += 1
    return begin, *best[1:]


def licence_spans(text: str, model: LicenceModel) -> list[tuple[int, int, str]]:
    """(start, end, family) of the paragraphs that name a licence."""
    lines, at = [], 0
    for line in text.split("\n"):
        words = _find(line.lower())
        own = grams(words) if words else set()
        family, held = model.judged_grams(own)
        lines.append((at, at + len(line), words, family, own, held))
        at += len(line) + 1
    out, k = [], 0
    while k < len(lines):
        start, end, words, family, own, held = lines[k]
        found = _wrapped(lines, k, model) if words else None
        if found and found[3] > (family not in (None, UNKNOWN), held if family else -1.0):
            out.append((lines[found[0]][0], lines[found[1]][1], found[2]))
            k = found[1] + 1
            continue
        if family:
            out.append((start, end, family))
        k += 1
    return out


def _scan(batches, model: LicenceModel):
    for batch in sliced(batches):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = licence_spans(text or "", model)
            rows.append((doc, len(found), ",".join(sorted({f for _, _, f in found})), ",".join(f"{f}:{a}:{b}" for a, b, f in found)))
        if rows:
            types = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list("abcd"))


def scan_licences(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_licences, families, spans per row of docs."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(base.dtypes)['doc_id']}, n_licences long, families string, spans string"
    return base.mapInArrow(lambda it: _scan(it, model), schema)


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_licences(docs, train_licences(docs))


QUERIES = {"op5_licences": op5_licences}
ORACLE_SQL: dict[str, str] = {}
