"""Filters of large tables by a set of keys without moving the tables.

The keys' hash places are set in a bitmap, built by Spark's bitmap aggregates part by part and sent to all tasks. Its size is checked:
it takes ``BITS_A_KEY`` bits a key and ``MOST_BITS`` at most; beyond that nothing is filtered, and the join that
follows does all the work. A bit may be set by another key, so what passes is a superset of what is wanted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_A_KEY, MOST_BITS = 16, 1 << 28
_PART = 8 * 4096


def _bitmap(keys: DataFrame, column: str, most_bits: int) -> tuple[int, np.ndarray] | None:
    """Number of places, and bits of those of keys' column; None if they would be too many."""
    bits = max(_PART, 1 << (BITS_A_KEY * keys.count() - 1).bit_length())
    if bits > most_bits:
        return None
    # Spark's bitmaps count from 1
    place = (F.pmod(F.xxhash64(F.col(column)), F.lit(bits)) + 1).alias("place")
    parts = keys.select(place).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).toArrow()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for part, own in zip(parts.column("part").to_pylist(), parts.column("bits").to_pylist(), strict=True):
        out[(part - 1) * 4096 : part * 4096] = np.frombuffer(own, dtype=np.uint8)
    return bits, out


def may_be_in(df: DataFrame, column: str, keys: DataFrame, key: str | None = None, then: Callable[[Iterator], Iterator] | None = None, schema=None, most_bits: int = MOST_BITS) -> DataFrame:
    """Rows of df whose column may be among keys, with all of those that are; then: a function of Arrow batches that goes on in the same pass."""
    made = _bitmap(keys, key or column, most_bits)
    if made is None:
        return df.mapInArrow(then, schema) if then else df
    bits, found = made

    def some(batches):
        for batch in batches:
            place = batch.column(batch.num_columns - 1).to_numpy()
            mask = found[place >> 3] >> (place & 7).astype(np.uint8) & 1
            own = batch.select(list(range(batch.num_columns - 1)))
            yield own.filter(pa.array(mask.astype(bool)))

    placed = df.select("*", F.pmod(F.xxhash64(F.col(column)), F.lit(bits)).alias("_place"))
    return placed.mapInArrow((lambda it: then(some(it))) if then else some, schema or df.schema)
