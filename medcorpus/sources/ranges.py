"""Records of files that no line feed ends: quoted text over several lines, and objects of a JSON array.

Spark's text reader cuts a file into byte ranges at any separator, in parallel: at line feeds for a table of quoted fields, at closing
braces for JSON. Whether a separator ends a record depends on all that stands before it in the file, but only through a small state (inside
quotes or not; and the depth of braces). So one pass sums up each range: what it makes of either state. Those sums, a row a range, are added up
along each file, which gives every range the state that it begins in. The second pass puts records together from the pieces
between separators. A record that goes over the end of its range is passed on in parts, at most two a range, and joined.

Both passes must cut a file alike; a range of the second that the first did not see is an error, never a loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medcorpus.storage import stored

#: Up to so many ranges their states go to all tasks (about 40 bytes each); beyond that pieces are joined with them by shuffle.
BROADCAST_RANGES = 1_000_000
#: Records leave a task this many at a time.
ROWS = 500

#: A state is (inside quotes, depth). The new state after a piece and the separator that ends it; None for a piece outside of records.
Step = Callable[[bytes, tuple[int, int]], tuple[int, int] | None]


def quoted_line(piece: bytes, state: tuple[int, int]) -> tuple[int, int] | None:
    """Lines: a record ends where quotes are even."""
    return state[0] ^ piece.count(b'"') & 1, 0


def braces(piece: bytes, state: tuple[int, int]) -> tuple[int, int] | None:
    """Pieces between closing braces: an object ends where the depth is zero."""
    inside, depth = state
    if depth == 0 and b"{" not in piece:
        return None
    if b"\\" in piece:
        piece = _without_escapes(piece)
    if b'"' not in piece:
        return (inside, depth) if inside else (0, depth + piece.count(b"{") - 1)
    parts = piece.split(b'"')
    opened = sum(p.count(b"{") for p in parts[inside::2])
    inside ^= len(parts) - 1 & 1
    return inside, depth + opened - (0 if inside else 1)


def _without_escapes(piece: bytes) -> bytes:
    return piece.replace(b"\\\\", b"").replace(b'\\"', b"")


def pieces(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """file (a hash of its path), block (its range's first byte) and value of all pieces, in order inside a range."""
    meta = F.col("_metadata")
    return spark.read.text(path, lineSep=separator).select(F.xxhash64(meta["file_path"]).alias("file"), meta["file_block_start"].alias("block"), F.col("value"))


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, as in pieces, and archive, the file's path."""
    own = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("archive"))
    return own.select(F.xxhash64("archive").alias("file"), F.url_decode("archive").alias("archive"))


def quote_sums(value: Column) -> list[Column]:
    """quotes, and the change of depth from either state, of a line."""
    return [(F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))).alias("quotes"), F.lit(0).alias("from_out"), F.lit(0).alias("from_in")]


def brace_sums(value: Column) -> list[Column]:
    """As quote_sums, of a piece that ends with a closing brace."""
    plain = F.replace(F.replace(value, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    count = lambda x, what: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(what), F.lit("")))
    quotes = count(plain, '"')
    outside = count(F.regexp_replace(plain, '"[^"]*+("|$)', ""), "{")
    inside = count(F.regexp_replace(F.regexp_replace(plain, '^[^"]*+("|$)', ""), '"[^"]*+("|$)', ""), "{")
    return [quotes.alias("quotes"), (outside - F.when(quotes % 2 == 0, 1).otherwise(0)).alias("from_out"), (inside - F.when(quotes % 2 == 1, 1).otherwise(0)).alias("from_in")]


def range_sums(batches) -> Iterator[pa.RecordBatch]:
    """A row a range, of pieces' (file, block, quotes, from_out, from_in): the sums of its pieces, put one after another."""
    key, sums = None, None
    for b in batches:
        done = []
        for file, block, quotes, out, own in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if (file, block) != key:
                done += [(*key, *sums)] if key else []
                key, sums = (file, block), (0, 0, 0)
            odd, a, c = sums
            sums = (odd + quotes & 1, a + (own if odd else out), c + (out if odd else own))
        yield _range_rows(done)
    if key:
        yield _range_rows([(*key, *sums)])


def _range_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = [[r[i] for r in rows] for i in range(5)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["file", "block", "quotes", "from_out", "from_in"])


def begin_states(spark: SparkSession, path: str | list[str], separator: str, sums: Callable[[Column], list[Column]]) -> DataFrame:
    """file, block, inside, depth: the state in which each range begins; odd: whether the file's quotes are odd in all."""
    cut = pieces(spark, path, separator).select("file", "block", *sums(F.col("value")))
    # pieces of a range come to one task, in order
    each = stored(cut.mapInArrow(range_sums, "file long, block long, quotes long, from_out long, from_in long"))
    order = W.partitionBy("file").orderBy("block")  # a row for each range of a file
    before = order.rowsBetween(W.unboundedPreceding, -1)
    x = each.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    x = x.withColumn("change", F.when(F.col("inside") == 0, F.col("from_out")).otherwise(F.col("from_in")))
    odd = (F.sum("quotes").over(W.partitionBy("file")) % 2 == 1).alias("odd")
    return stored(x.select("file", "block", "inside", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"), odd))


def _put_together(batches, step: Step, glue: bytes, closing: bytes) -> Iterator[pa.RecordBatch]:
    """Records of pieces (file, block, inside, depth, value): text of those inside a range; parts, with their place, of the others."""
    key, state, parts, begun, first, out = None, (0, 0), [], True, True, []

    def put(begins: bool, ends: bool) -> None:
        whole = begins and ends
        at = None if whole else int(begins)
        out.append((key[0], None if whole else key[1], at, begins, first and key[1] == 0, glue.join(parts) + (closing if ends else b"")))

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
        arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "block", "at", "begins", "first", "text"])

    for b in batches:
        for file, block, inside, depth, value in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if (file, block) != key:
                if parts:
                    put(begun, False)
                key, state, parts, first = (file, block), (inside, depth), [], True
                begun = state == (0, 0)
            new = step(value, state)
            if new is None:
                continue
            parts.append(value)
            state = new
            if state == (0, 0):
                put(begun, True)
                parts, begun, first = [], True, False
            if len(out) >= ROWS:
                yield batch()
                out.clear()
    if parts:
        put(begun, False)
    if out:
        yield batch()


def records(spark: SparkSession, path: str | list[str], separator: str, step: Step, begins: DataFrame, closing: str = "") -> DataFrame:
    """first (of its file) and text of all records; begins: from begin_states. Pieces are joined by the separator, and closing ends a record.

    Records are stored only if some may go over the end of a range; else they are put together where they are used.
    """
    cut = pieces(spark, path, separator)
    states = begins.select("file", "block", "inside", "depth")
    if begins.count() <= BROADCAST_RANGES:
        met = cut.join(F.broadcast(states), ["file", "block"], "left")
    else:
        met = cut.withColumn("_n", F.monotonically_increasing_id()).join(states, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("_n")
    unseen = F.when(F.col("inside").isNull(), F.raise_error(F.lit("files were cut into other ranges than before"))).otherwise(F.col("inside"))
    rows = met.select("file", "block", unseen.cast("int").alias("inside"), F.col("depth").cast("int").alias("depth"), F.col("value").cast("binary").alias("value"))
    glue, end = separator.encode(), closing.encode()
    found = rows.mapInArrow(lambda it: _put_together(it, step, glue, end), "file long, block long, at int, begins boolean, first boolean, text binary")
    if not begins.filter("block > 0").head(1):
        # every file is one range, as a compressed one always is: no record goes over a border, so none has to wait for its other parts
        return found.select("first", F.col("text").cast("string").alias("text"))
    found = stored(found)
    order = W.partitionBy("file").orderBy("block", "at").rowsBetween(W.unboundedPreceding, 0)  # two parts a range at most
    parts = found.filter("block is not null").withColumn("record", F.sum(F.col("begins").cast("int")).over(order))
    inside = F.sort_array(F.collect_list(F.struct("block", "at", F.hex("text").alias("text"))))
    joined = parts.groupBy("file", "record").agg(F.max("first").alias("first"), inside.alias("parts"))
    joined = joined.select("first", F.unhex(F.array_join(F.col("parts.text"), glue.hex().upper())).cast("string").alias("text"))
    return found.filter("block is null").select("first", F.col("text").cast("string").alias("text")).unionByName(joined)
