"""Seeded samples, splits and rankings.

The order of a sample is the md5 of seed, salt and key, so it does not depend on how the rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medcorpus import storage
from medcorpus.functions.text import hash_number, rank_key


def seeded(seed: int, salt: str, *keys: str) -> list[Column]:
    return [rank_key(seed, salt, *[F.col(k) for k in keys]), *[F.col(k) for k in keys]]


def sample_n(df: DataFrame, n: int, seed: int, *keys: str, salt: str = "sample") -> DataFrame:
    """n rows without replacement; all if n is 0 or less."""
    return df.orderBy(*seeded(seed, salt, *keys)).limit(n) if n > 0 else df


def sample_in_order(df: DataFrame, n: int, seed: int, *keys: str, salt: str = "sample") -> DataFrame:
    """As sample_n, in the order of the keys."""
    return sample_n(df, n, seed, *keys, salt=salt).orderBy(*keys)


def sample_exactly(df: DataFrame, n: int, seed: int, *keys: str, salt: str = "sample") -> DataFrame:
    """As sample_in_order, but a table of fewer than n rows is an error."""
    there = df.limit(n).count() if n > 0 else 0
    if there < n:
        raise ValueError(f"{n} rows are wanted and {there} are there")
    return sample_in_order(df, n, seed, *keys, salt=salt)


def _first_in_group(df: DataFrame, group: str, n: int, order: list[Column]) -> DataFrame:
    """Up to n rows of each group, least first. Rows are cut to n a group and part before the last cut."""
    parts = F.pmod(F.xxhash64(*df.columns), F.lit(64))
    within = F.row_number().over(W.partitionBy(group, "_part").orderBy(*order))
    cut = df.withColumn("_part", parts).withColumn("_rn", within).filter(F.col("_rn") <= n).drop("_rn", "_part")
    return cut.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def sample_per_group(df: DataFrame, group: str, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows of each group, fewer where it is short."""
    return _first_in_group(df, group, n, seeded(seed, "group", *keys))


def take_target(df: DataFrame, target: int, oversample: float, seed: int, key: str, ok: Column) -> DataFrame:
    """pool, kept and seen: the first target survivors of a seeded pool, and the rows looked at until there."""
    pool = sample_n(df, int(target * oversample), seed, key, salt="pool").withColumn("_rank", rank_key(seed, "pool", F.col(key)))
    order = W.orderBy("_rank", key)  # a pool holds target * oversample rows at most
    pool = pool.withColumn("ok", ok).withColumn("_n", F.sum(F.col("ok").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    seen = (F.col("_n") < target) | (F.col("ok") & (F.col("_n") == target))
    return pool.withColumns({"seen": seen, "kept": F.col("ok") & (F.col("_n") <= target)}).drop("_rank", "_n")


def seeded_places(df: DataFrame, group: str, seed: int, salt: str, key: str, parts: int = 256) -> DataFrame:
    """df with _rn, each row's place from 1 in its group's seeded order, and _size, the group's size.

    Two passes: a group is cut into parts by the beginning of its rank, the parts' sizes give each its offset, and rows
    are numbered inside a part. So a table of two or three classes is still many tasks.
    """
    x = df.withColumn("_rank", rank_key(seed, salt, F.col(key)))
    x = x.withColumn("_part", F.floor(F.conv(F.substring("_rank", 1, 4), 16, 10).cast("int") * parts / 65536).cast("int"))
    sizes = x.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    w = W.partitionBy(group)  # parts rows a group
    offsets = sizes.select(group, "_part", (F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_size"))
    inside = F.row_number().over(W.partitionBy(group, "_part").orderBy("_rank", key))
    return x.join(offsets, [group, "_part"]).withColumn("_rn", inside + F.col("_before")).drop("_rank", "_part", "_before")


def seen_until_target(df: DataFrame, group: str, target: int, seed: int, salt: str, key: str, ok: Column, parts: int = 256) -> DataFrame:
    """df with kept, the first target rows of each group's seeded order that are ok, and seen, all rows up to the last of them.

    Two passes, as in seeded_places: the ok rows of the parts before are summed up, and rows are counted inside a part.
    """
    x = df.withColumn("_ok", ok.cast("int")).withColumn("_rank", rank_key(seed, salt, F.col(key)))
    x = x.withColumn("_part", F.floor(F.conv(F.substring("_rank", 1, 4), 16, 10).cast("int") * parts / 65536).cast("int"))
    # parts rows a group
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = x.groupBy(group, "_part").agg(F.sum("_ok").alias("_sum")).select(F.col(group).alias("_group"), "_part", before.alias("_before"))
    inside = F.sum("_ok").over(W.partitionBy(group, "_part").orderBy("_rank", key).rowsBetween(W.unboundedPreceding, 0))
    x = x.join(offsets, x[group].eqNullSafe(offsets["_group"]) & (x["_part"] == offsets["_part"])).drop(offsets["_part"]).withColumn("_n", F.col("_before") + inside)
    is_ok = F.col("_ok") == 1
    return x.withColumns({"seen": (F.col("_n") < target) | (is_ok & (F.col("_n") == target)), "kept": is_ok & (F.col("_n") <= target)}).drop("_ok", "_rank", "_part", "_group", "_before", "_n")


def oversample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows of each group: without replacement where it has n, else with replacement. slot numbers them."""
    ranked = seeded_places(df, group, seed, "over", key)
    sizes = df.groupBy(group).agg(F.count("*").alias("_size"))
    slots = sizes.select(group, "_size", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("slot"))
    drawn = hash_number(F.lit(seed), F.col(group), F.col("slot")) % F.col("_size") + 1
    slots = slots.withColumn("_rn", F.when(F.col("_size") >= n, F.col("slot")).otherwise(drawn).cast("long")).drop("_size")
    return slots.join(ranked.drop("_size"), [group, "_rn"]).drop("_rn")


def stratified_half_split(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """half: train for the first half of each label's seeded order, else test."""
    x = seeded_places(df, label, seed, "half", key)
    return x.withColumn("half", F.when(F.col("_rn") <= F.floor(F.col("_size") / 2), "train").otherwise("test")).drop("_rn", "_size").select(*df.columns, "half")


def write_split_once(split: DataFrame, path: str) -> DataFrame:
    """The split stored at path, which is written if none was finished there yet and never overwritten; of two writers the first one's split stays."""
    spark = split.sparkSession
    if not (found := storage.entries(spark, path).get("split")):
        storage.enter(spark, path, "split", {"path": storage.write_data(split, path), "format": "parquet", "columns": split.columns})
        found = storage.entries(spark, path)["split"]
    return storage.read_entry(spark, found)


def ratio_split(df: DataFrame, cap: int, ratio: float, seed: int, key: str) -> DataFrame:
    """split: of at most cap rows, max(1, n * ratio) for val and the rest for train."""
    rows = sample_n(df, cap, seed, key, salt="ratio")
    n = rows.count()
    val = rows.orderBy(*seeded(seed, "ratio", key)).limit(max(1, int(n * ratio))).select(key, F.lit("val").alias("split"))
    return rows.join(val, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def val_split_by_document(chunks: DataFrame, frac: float, seed: int, cap: int = 100) -> DataFrame:
    """split of chunks(source, doc_id, chunk_no): about frac of each source's chunks for val.

    Documents are walked in seeded order. A short one goes whole, a long one gives its last chunks, the last document
    of a source stays. The walk looks at cap + 1 documents of a source at most, whatever its size.
    """
    docs = chunks.groupBy("source", "doc_id").agg(F.count("*").alias("n"))
    totals = docs.groupBy("source").agg(F.sum("n").alias("total"), F.count("*").alias("docs"))
    first = _first_in_group(docs.withColumn("rank", rank_key(seed, "val", F.col("doc_id"))), "source", cap + 1, [F.col("rank"), F.col("doc_id")])
    wanted = F.when(F.col("total") >= 20, F.least(F.lit(cap), F.greatest(F.lit(1), F.bround(F.col("total") * frac)))).otherwise(0).cast("long")
    order = W.partitionBy("source").orderBy("rank", "doc_id")  # cap + 1 documents a source
    before = order.rowsBetween(W.unboundedPreceding, -1)
    # up to the first document that only gives its tail, all before went whole; so what is still wanted is a running difference
    x = first.join(totals, "source").withColumn("left", wanted - F.coalesce(F.sum("n").over(before), F.lit(0)))
    x = x.withColumn("whole", F.col("n") <= F.greatest(2 * F.col("left"), F.lit(3)))
    reached = (F.col("left") > 0) & F.coalesce(F.min("whole").over(before), F.lit(True)) & (F.row_number().over(order) < F.col("docs"))
    taken = x.withColumn("reached", reached).filter("reached")
    taken = taken.select("source", "doc_id", F.when(F.col("whole"), F.lit(0)).otherwise(F.col("n") - F.col("left")).alias("tail_from"))
    is_val = F.col("tail_from").isNotNull() & (F.col("chunk_no") >= F.col("tail_from"))
    return chunks.join(taken, ["source", "doc_id"], "left").withColumn("split", F.when(is_val, "val").otherwise("train")).drop("tail_from")


def one_per_subject(df: DataFrame, subject: str, item: str, n: int, seed: int) -> DataFrame:
    """One seeded item of each subject, then n seeded subjects."""
    one = df.groupBy(subject).agg(F.min_by(item, F.struct(rank_key(seed, "item", F.col(item)), F.col(item))).alias(item))
    return sample_n(one, n, seed, subject, salt="subject")


def top_k(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best by score, ties by key."""
    return df.orderBy(F.desc(score), key).limit(k)


def shortest_k(df: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """The k shortest texts, ties by key."""
    return df.orderBy(F.length(text), key).limit(k)


def most_common(df: DataFrame, col: str) -> DataFrame:
    """Values by how often they occur."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)
