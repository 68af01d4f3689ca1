"""Deduplication and set operations on tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medcorpus.functions.text import rank_key


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order; partial aggregation keeps one row a key and task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order)) if rest else F.min(F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def dedupe_across_sources(df: DataFrame, source: str, priority: list[str], key: str, order: str, quota: dict[str, int]) -> DataFrame:
    """Sources in their priority: each gives its first rows by order, up to its quota, whose key no kept row has yet."""
    kept = None
    for name in priority:
        own = dedupe_first(df.filter(F.col(source) == name), [key], [order])
        if kept is not None:
            own = own.join(kept.select(key), key, "left_anti").select(*df.columns)
        own = own.orderBy(order).limit(quota[name])
        kept = own if kept is None else kept.unionByName(own)
    return kept


def content_fingerprint(header: Column, data: Column) -> Column:
    """A fingerprint of content and its size header."""
    return F.md5(F.concat(header.cast("binary"), data))


def union_training_sets(parts: list[DataFrame], seed: int, *key: str, limit: int | None = None) -> DataFrame:
    """All parts in one seeded order."""
    rows = reduce(DataFrame.unionByName, parts).orderBy(rank_key(seed, "union", *[F.col(k) for k in key]), *key)
    return rows.limit(limit) if limit else rows


def selection_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys two selections share."""
    return a.select(key).intersect(b.select(key)).agg(F.count("*").alias("n_shared"))


def bad_ids(df: DataFrame, key: str, required: str) -> DataFrame:
    """Keys that are missing, repeated, or without a required text; none if the table is sound."""
    counted = df.groupBy(key).agg(F.count("*").alias("n"), F.min(F.length(F.trim(F.coalesce(F.col(required), F.lit(""))))).alias("shortest"))
    return counted.filter(F.col(key).isNull() | (F.col("n") > 1) | (F.col("shortest") == 0)).select(key, "n")

