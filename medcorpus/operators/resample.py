"""Resampling intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medcorpus.functions.text import hash_number
from medcorpus.storage import stored


#: Distinct values of a group that one task draws from, and numbers that it draws at a time.
PART_VALUES, DRAWN_AT_ONCE = 65_536, 1 << 22


def bootstrap_ci(df: DataFrame, groups: list[str], value: str, draws: int = 2000, seed: int = 0, part_values: int = PART_VALUES) -> DataFrame:
    """groups, n, mean, lo, hi (in per cent): the 95 % interval of the mean of n draws with replacement.

    Spark collapses each group to its distinct values; drawing n items is a multinomial over those, so the cost does not depend on n. A group of
    many values is dealt over parts: first the parts' totals of every draw are drawn, then each part draws its total from its own
    values, which together is the same multinomial. A task so holds part_values values, and a draw is one sum for each part.
    """
    kinds = dict(df.dtypes)
    own = ", ".join(f"`{g}` {kinds[g]}" for g in groups)
    hist = stored(df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")))
    parts = hist.groupBy(*groups).agg(F.count("*").alias("_values")).select(*[F.col(g).alias(f"_of_{g}") for g in groups], F.ceil(F.col("_values") / part_values).alias("_parts"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups])
    dealt = hist.join(parts, same).withColumn("_part", F.pmod(F.xxhash64("_v"), "_parts").cast("int")).select(*groups, "_part", "_v", "_c")
    sizes = dealt.groupBy(*groups, "_part").agg(F.sum("_c").alias("_n"))

    def totals(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_part")
        n = p["_n"].to_numpy()
        drawn = np.random.default_rng(seed).multinomial(int(n.sum()), n / n.sum(), size=draws)
        return pd.DataFrame([[*key, part, drawn[:, k]] for k, part in enumerate(p["_part"])])

    def sums(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_v")
        x, c, wanted = p["_v"].to_numpy(dtype=float), p["_c"].to_numpy(), np.asarray(p["_totals"].dropna().iloc[0])
        rng, out = np.random.default_rng([seed, int(key[-1])]), np.empty(draws)
        step = max(1, DRAWN_AT_ONCE // len(x))
        for k in range(0, draws, step):
            out[k : k + step] = rng.multinomial(wanted[k : k + step], c / c.sum()) @ x
        return pd.DataFrame([[*key[:-1], int(c.sum()), float(x @ c), out]])

    drawn = sizes.groupBy(*groups).applyInPandas(totals, f"{own}, _part int, _totals array<long>")
    # a part's totals come once, with one of its values
    first = F.row_number().over(W.partitionBy(*groups, "_part").orderBy("_v")) == 1
    renamed = drawn.select(*[F.col(g).alias(f"_of_{g}") for g in groups], F.col("_part").alias("_of_part"), F.col("_totals"))
    met = dealt.withColumn("_first", first).join(renamed, same & (F.col("_part") == F.col("_of_part")) & F.col("_first"), "left").select(*groups, "_part", "_v", "_c", "_totals")
    each = met.groupBy(*groups, "_part").applyInPandas(sums, f"{own}, n long, total double, sums array<double>")
    added = F.aggregate("_all", F.array_repeat(F.lit(0.0), draws), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    # a row for each part of a group
    whole = each.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.collect_list("sums").alias("_all")).withColumn("_means", F.sort_array(added))
    at = lambda k: F.get("_means", F.lit(k)) / F.col("n") * 100
    return whole.select(*groups, "n", (F.col("total") / F.col("n") * 100).alias("mean"), at(int(0.025 * draws)).alias("lo"), at(int(0.975 * draws) - 1).alias("hi"))


def paired_differences(df: DataFrame, keys: list[str], reference: str) -> DataFrame:
    """keys, tag, diff against the reference tag on common items of (tag, keys, score)."""
    ref = df.filter(F.col("tag") == reference).select(*keys, F.col("score").alias("_ref"))
    return df.filter(F.col("tag") != reference).join(ref, keys).select(*keys, "tag", (F.col("score") - F.col("_ref")).alias("diff"))


def paired_diff_ci(df: DataFrame, groups: list[str], keys: list[str], reference: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """The interval of the paired differences by groups and tag, and whether it leaves out 0."""
    out = bootstrap_ci(paired_differences(df, [*groups, *keys], reference), [*groups, "tag"], "diff", draws, seed)
    return out.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


def poisson_bootstrap(df: DataFrame, key: str, value: str, draws: int, seed: int) -> DataFrame:
    """b, mean: the weighted mean of each replicate, with Poisson(1) weights from seeded hashes; sums are combined on the map side.

    A row is hashed once; its draws are steps of a multiplicative generator from there, so they differ by row and by replicate.
    """
    rows = df.select(hash_number(F.lit(seed), F.col(key)).alias("_h"), F.col(value).cast("double").alias("_v"))
    return rows.mapInArrow(lambda it: _poisson_sums(it, draws), "b int, total double, weight long").groupBy("b").agg((F.sum("total") / F.sum("weight")).alias("mean"), F.sum("weight").alias("weight"))


#: The multipliers of the generator, and where a Poisson(1) number passes 1 to 8.
MIX, AGAIN, STEP = (40503, 30011), (50021, 62989), 2654435761
BELOW = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])


def _poisson_sums(batches, draws: int) -> Iterator[pa.RecordBatch]:
    """The weighted sums of a partition's rows for each replicate, added up in place, so that no row is copied by the number of replicates."""
    total, weight, b = np.zeros(draws), np.zeros(draws, dtype=np.int64), np.arange(1, draws + 1, dtype=np.int64)
    some = False
    for batch in batches:
        h, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        for at in range(0, len(h), max(1, (1 << 20) // draws)):
            part = slice(at, at + max(1, (1 << 20) // draws))
            x, own = h[part, None], v[part]
            mixed = (x & 65535) * MIX[0] + (x >> 16) * MIX[1] + b[None] * STEP & 4294967295
            u = ((mixed & 65535) * AGAIN[0] + (mixed >> 16) * AGAIN[1] + mixed & 4294967295) / 4294967296.0
            w = np.searchsorted(BELOW, u, side="right")
            total += np.where(np.isnan(own), 0.0, own) @ w
            weight += w.sum(axis=0)
            some = True
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(total), pa.array(weight)], names=["b", "total", "weight"])


def sub_scores(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """tag, sub, item, score: each rule's score of the rows that it is for; one pass, no union."""
    parts = F.array(*[F.when(of, F.struct(F.lit(name).alias("sub"), score.cast("double").alias("score"))) for name, (of, score) in rules.items()])
    return df.select("tag", "item", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("s")).select("tag", "s.sub", "item", "s.score")
