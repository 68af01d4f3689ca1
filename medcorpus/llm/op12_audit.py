"""Audit of how filters act on each other, in every order of them.

A document's failures are a mask of bits. Documents of one part, mask and labels are only counted, so what is left of a part is at most
a row for each mask. In the min-plus product of the masks (0 where the filter fails, else infinity) and the inverse
permutations (the position of each filter in each order), the entry of a mask and an order is the least position of a failing filter:
the step that removes these documents. The counts are then scattered to these steps, as weights; a filter that fails
later than that is redundant for them.

The only filter that looks at other documents is E, a copy of a smaller doc_id's text. Equality is that of the texts' SHA-256. Rows are
counted by digest before they meet, so a hot text is one row for each task, part and label.

Cases: a null text is empty, a null lang is the empty part, a document without a label is neither good nor toxic; one with several is good
(toxic) if any says so. Rows are counted one by one: repeated rows with the smallest doc_id of their text are all kept by E, since no
smaller id has it; a null doc_id is not smaller than any and never fails E. Very long texts are read whole; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medcorpus.llm.common import table

FILTERS = "ABCDE"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def text_failures(text: Column, words: Column) -> list[Column]:
    """Conditions A to D of a text that is not null and its words."""
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals > 3 * F.length(text), text.rlike(r"[#$%&*|]")]


def as_mask(conditions: Sequence[Column]) -> Column:
    """Bit k is set where condition k holds."""
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0))


def counted_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic of documents(doc_id, text, lang) by the five filters."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", split_words(F.col("text")))
    rows = rows.select("doc_id", "part", as_mask(text_failures(F.col("text"), F.col("words"))).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    said = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(said, "doc_id", "left").select("doc_id", "digest", "part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    kinds = ["digest", "part", "mask", "good", "toxic"]
    # rows of one id first: the join has dealt them by it
    ids = rows.groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    own = ids.groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("nameless"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"))
    first = F.min("least.doc_id").over(W.partitionBy("digest"))
    own = own.withColumn("first", first).withColumn("stay", F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0))
    copy = 1 << FILTERS.index("E")
    both = F.inline(F.array(F.struct(F.col("mask"), F.col("stay").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("stay")).alias("n"))))
    split = own.select("part", "good", "toxic", both).filter("n > 0")
    weight = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), weight("good"), weight("toxic"))


def removal_steps(n_filters: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders of n filters, and for each mask and order the step (1 to n) that removes it, n + 1 if none does."""
    orders = np.array(list(permutations(range(n_filters))))
    position = np.argsort(orders, axis=1) + 1
    fails = np.arange(1 << n_filters)[:, None] >> np.arange(n_filters) & 1
    cost, steps = np.where(fails, 0, n_filters + 1), np.full((1 << n_filters, len(orders)), n_filters + 1)
    for k in range(n_filters):
        np.minimum(steps, cost[:, k, None] + position[None, :, k], out=steps)
    return orders, steps


def _audited(batches, filters: str) -> Iterator[pa.RecordBatch]:
    n = len(filters)
    orders, steps = removal_steps(n)
    masks, m = np.arange(1 << n), len(orders)
    names = ["".join(filters[f] for f in o) for o in orders]
    for batch in batches:
        for part, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            weight = np.zeros((3, 1 << n), dtype=np.int64)
            for x in own:
                weight[:, x["mask"]] += (x["n"], x["good"], x["toxic"])
            # counts of each order and step; the last place is for what stays
            place = np.arange(m)[None, :] * (n + 1) + steps - 1
            removed, good, toxic = (np.zeros(m * (n + 1), dtype=np.int64) for _ in range(3))
            for to, w in zip((removed, good, toxic), weight, strict=True):
                np.add.at(to, place, w[:, None])
            removed, good, toxic = (x.reshape(m, n + 1) for x in (removed, good, toxic))
            redundant = np.empty((m, n), dtype=np.int64)
            for s in range(n):
                late = (masks[:, None] >> orders[None, :, s] & 1 == 1) & (steps <= s)
                redundant[:, s] = (weight[0][:, None] * late).sum(axis=0)
            taken = removed[:, :n]
            shapley = np.zeros(n, dtype=np.int64)
            np.add.at(shapley, orders, taken)
            columns = [weight[0].sum() - np.cumsum(taken, axis=1), taken, redundant, weight[0][1 << orders], good[:, :n], toxic[:, :n], shapley[orders]]
            arrays = [pa.array([part] * (m * n), pa.string()), pa.array([x for x in names for _ in range(n)]), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), m))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(c.ravel()) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])


def audit_filters(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """SCHEMA's row per part, order of filters and step, from the part, mask, n, good and toxic of counts; bit k of a mask is filter k, a letter."""
    each = counts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    parts = each.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("own"))
    return parts.mapInArrow(lambda it: _audited(it, filters), SCHEMA)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(counted_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLE_SQL = {
    "op12_filter_audit": r"""with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
    l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
    f as (select part, coalesce(good, false) good, coalesce(toxic, false) toxic, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)::int as mask from d left join l on d.doc_id = l.doc_id),
    m as (select part, mask, count(*) n, count(*) filter (where good) g, count(*) filter (where toxic) x from f group by 1, 2),
    b(l) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
    p as (select a.l || b.l || c.l || d.l || e.l o from b a, b b, b c, b d, b e where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
    fails as (select mask, s, o, mask >> (ascii(substr(o, s, 1)) - 65) & 1 = 1 as bad from range(32) k(mask), p, range(1, 6) r(s)),
    gone as (select mask, o, coalesce(min(s) filter (where bad), 6) as step from fails group by 1, 2),
    r as (select part, o, s, substr(o, s, 1) letter, coalesce(sum(n) filter (where step > s), 0) kept, coalesce(sum(n) filter (where step = s), 0) removed,
    coalesce(sum(n) filter (where step < s and bad), 0) redundant, coalesce(sum(n) filter (where mask = 1 << (ascii(substr(o, s, 1)) - 65)), 0) unique_fails,
    coalesce(sum(g) filter (where step = s), 0) good_lost, coalesce(sum(x) filter (where step = s), 0) toxic_lost
    from m join fails using (mask) join gone using (mask, o) group by part, o, s)
    select part, o as filter_order, s::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
    good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from r"""
}
