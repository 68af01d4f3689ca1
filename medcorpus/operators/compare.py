"""Tables that compare models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_answers(df: DataFrame, key: str, models: list[str]) -> DataFrame:
    """One row per item with each model's answer (null where it has none), the first question given, and the gaps."""
    wide = df.groupBy(key).pivot("tag", models).agg(F.first("pred"))
    question = df.filter("question is not null").groupBy(key).agg(F.min_by("question", "tag").alias("question"))
    gaps = reduce(lambda a, b: a + b, [F.col(m).isNull().cast("int") for m in models])
    return wide.join(question, key, "left").withColumn("gaps", gaps)


def pick_wins(df: DataFrame, key: str, winner: str, models: list[str], k: int) -> DataFrame:
    """The k shortest items (key, size) that only the winner has right."""
    wide = df.groupBy(key, "size").pivot("tag", models).agg(F.max("score"))
    lost = reduce(lambda a, b: a & b, [F.col(m) == 0 for m in models if m != winner])
    return wide.filter((F.col(winner) == 1) & lost).orderBy("size", key).limit(k)


def metric_table(df: DataFrame, tags: list[str], overrides: DataFrame | None = None) -> DataFrame:
    """metric by tag; a metric and tag in overrides takes that value."""
    if overrides is not None:
        df = df.join(overrides.withColumnRenamed("value", "_over"), ["metric", "tag"], "full").select("metric", "tag", F.coalesce("_over", "value").alias("value"))
    return df.groupBy("metric").pivot("tag", tags).agg(F.max("value"))


def seed_consistency(wide: DataFrame, seeds: list[str]) -> DataFrame:
    """Differences b - a within each seed of columns a_<seed>, b_<seed>, and whether all have one sign (null if any is missing)."""
    diffs = [(F.col(f"b_{s}") - F.col(f"a_{s}")).alias(f"diff_{s}") for s in seeds]
    out = wide.select("metric", *diffs)
    product = reduce(lambda a, b: a * b, [F.signum(f"diff_{s}") for s in seeds[1:]], F.signum(f"diff_{seeds[0]}"))
    return out.withColumn("same_sign", product > 0) if len(seeds) == 2 else out.withColumn("same_sign", F.abs(reduce(lambda a, b: a + b, [F.signum(f"diff_{s}") for s in seeds])) == len(seeds))


def pick_hyperparameter(df: DataFrame, rate: str, loss: str, within: float = 0.01) -> DataFrame:
    """The smallest rate whose loss is within a share of the best."""
    best = df.agg(F.min(loss).alias("_best"))
    # a table of one row
    return df.join(best).filter(F.col(loss) <= F.col("_best") * (1 + within)).agg(F.min(rate).alias(rate))


def dose_response(df: DataFrame, groups: list[str], value: Column) -> DataFrame:
    """Every seed's value in order, and their mean."""
    return df.groupBy(*groups).agg(F.array_sort(F.collect_list(value)).alias("values"), F.avg(value).alias("mean"))
