"""Exact deduplication by deterministic block naming.

Every text that can have a copy is cut into blocks of fixed size. The distinct blocks are sorted and each gets
an integer name, its rank; then adjacent names are paired, the distinct pairs are sorted and named in the same
way, and so on, until each document has a single name. Two texts have the same name (and number of blocks) if
and only if they are equal: names come from comparing the blocks themselves, so no hash can make two texts
collide. A 64-bit fingerprint is only used to leave out texts that no other row can equal, since a text whose
fingerprint and length are unique has no copy.

DataFrame operations only. Distinct blocks are pre-aggregated before the shuffle, so copies cost one row a
task; ranks are taken within hash buckets of distinct blocks, four for each of the session's shuffle partitions, and are the same
however often a task runs again. What joins give to rows (marks of fingerprints, names of blocks, the row that stays)
is written to the shared folder first. So Spark knows its size and broadcasts it where it is small, and else both sides
of the join are plain shuffles, of which adaptive execution splits the partitions that a hot text fills.

Cases: a null text equals an empty one; of equal texts the row with the largest doc_id stays, a null doc_id
counts as the smallest; of repeated rows with that doc_id one stays, that with the largest hash of all its columns (any
of those that are equal in all); very long texts are more blocks and levels; an empty table gives no rows.
``exact_duplicates`` reads no other columns; ``drop_exact_duplicates`` returns them unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medcorpus.llm.common import saved, stored, table

BLOCK_CHARS = 4096
#: Distinct blocks are ranked in this many hash buckets for each shuffle partition.
BUCKETS_PER_PARTITION = 4


def _named(values: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Distinct keys of values with an integer name each: hash bucket and rank in it."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy(*keys))
    return values.select(*keys).distinct().withColumn("bucket", bucket).select(*keys, (F.col("bucket") * F.lit(1 << 40) + rank).alias("name"))


def name_texts(texts: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(row, n_blocks, name) per row of texts(row, text): names are equal where texts are."""
    spark = texts.sparkSession
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    pieces = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(pieces)
    cut = texts.select("row", pieces.alias("pieces"))
    blocks = cut.select("row", F.size("pieces").alias("n_blocks"), F.posexplode("pieces").alias("at", "block"))
    level = saved(blocks.join(stored(_named(blocks, ["block"], buckets)), "block").select("row", "n_blocks", F.col("at").cast("long"), "name"))
    most, paired = level.agg(F.max("n_blocks")).first()[0] or 0, 0
    done = level.filter("n_blocks = 1")
    while most > 1 << paired:
        left = level.filter(F.col("n_blocks") > 1 << paired)
        first = F.max(F.when(F.col("at") % 2 == 0, F.col("name")))
        second = F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1))
        pairs = left.groupBy("row", "n_blocks", F.shiftright("at", 1).alias("at")).agg(first.alias("a"), second.alias("b"))
        level = saved(pairs.join(stored(_named(pairs, ["a", "b"], buckets)), ["a", "b"]).select("row", "n_blocks", "at", "name"))
        paired += 1
        done = done.unionByName(level.filter(F.col("n_blocks") <= 1 << paired))
    return done.select("row", "n_blocks", "name")


def _twins(base: DataFrame) -> DataFrame:
    """print, n_bytes and true of the fingerprints that more than one row of base(print, n_bytes) has."""
    counted = base.groupBy("print", "n_bytes").agg(F.count("*").alias("n"))
    return stored(counted.filter("n > 1").select("print", "n_bytes", F.lit(True).alias("twice")))


def _judged(some: DataFrame, block_chars: int) -> DataFrame:
    """Rows of some(row, doc_id, tie, text, ...) without their texts, with keep_id, group_size and kept."""
    named = some.drop("text").join(name_texts(some.select("row", "text"), block_chars), "row")
    order = F.struct("doc_id", "tie", (-F.col("row")).alias("back"))
    best = named.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), F.max(order).alias("best"))
    best = stored(best.select("n_blocks", "name", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.back")).alias("keep_row")))
    return named.join(best, ["n_blocks", "name"]).withColumn("kept", F.col("row") == F.col("keep_row"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 per row of docs; normalise: Column -> Column, on the text."""
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    print_, n_bytes = F.xxhash64("text").alias("print"), F.octet_length("text").alias("n_bytes")
    marked = base.select("doc_id", "text", print_, n_bytes).join(_twins(base.select(print_, n_bytes)), ["print", "n_bytes"], "left")
    sha, twice = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), F.coalesce("twice", F.lit(False))
    marked = stored(marked.select("doc_id", F.when(F.col("twice"), F.col("text")).alias("text"), sha, twice.alias("twice"), F.monotonically_increasing_id().alias("row")))
    said = F.lower(F.hex("sha")).alias("text_sha256")
    alone = marked.filter("not twice").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), said)
    copies = _judged(marked.filter("twice").select("row", "doc_id", F.lit(0).alias("tie"), "text", "sha"), block_chars)
    return alone.unionByName(copies.select("doc_id", "keep_id", "group_size", "kept", said))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that stay, all their columns unchanged. Texts without a twin are only filtered, not moved again."""
    text, own = F.coalesce(F.col(text_col), F.lit("")), docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("r"), F.xxhash64(text).alias("print"), F.octet_length(text).alias("n_bytes"))
    twins = _twins(rows.select("print", "n_bytes"))
    some = rows.join(twins, ["print", "n_bytes"], "left_semi").select("r", F.xxhash64("r").alias("tie"), F.monotonically_increasing_id().alias("row"))
    some = stored(some)
    named = some.select("row", F.col(f"r.`{id_col}`").alias("doc_id"), "tie", F.coalesce(F.col(f"r.`{text_col}`"), F.lit("")).alias("text"))
    kept = stored(_judged(named, block_chars).filter("kept").select("row"))
    stay = rows.join(twins, ["print", "n_bytes"], "left_anti").select("r").unionByName(some.join(kept, "row", "left_semi").select("r"))
    return stay.select(*[F.col(f"r.`{c}`").alias(c) for c in own])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLE_SQL = {
    "op10_exact_dedup": """select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
    doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
    from documents window w as (partition by coalesce(text, ''))"""
}
