"""Bloom filters of 64-bit hashes, built in tasks and tested where the rows lie.

The hashes' places are set by Spark's bitmap aggregates, part by part, so only the finished bits come to the driver, and their number is bounded:
``BITS_A_KEY`` for each key and ``MOST_BITS`` (64 MB) at most. More keys make a fuller filter, which lets more rows pass; what passes is a
superset of what is wanted, and a join on the values themselves follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medcorpus.storage import short_lived_shuffles, stored

BITS_A_KEY, MOST_BITS, LEAST_BITS = 32, 1 << 29, 1 << 18
PLACES = 4
#: Spark's bitmaps are of this many bits.
_PART = 8 * 4096


class Bloom:
    """A filter of hashes given as unsigned 64-bit numbers."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def where(self, hashes: np.ndarray) -> np.ndarray:
        """The places of hashes that may be among the keys."""
        at = np.arange(len(hashes))
        for k in range(PLACES):
            own = hashes[at]
            place = ((own & self.mask) + np.uint64(k) * ((own >> np.uint64(32)) & self.mask | np.uint64(1))) & self.mask
            at = at[(self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        return at


def bloom_of(hashes: DataFrame, column: str, n: int) -> Bloom:
    """The filter of a column of signed 64-bit hashes; n: about how many there are."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * max(1, n) - 1).bit_length()))
    # places stay below 2 ** 32, so nothing overflows
    low = F.col(column).bitwiseAND(size - 1)
    step = F.shiftrightunsigned(F.col(column), 32).bitwiseAND(size - 1).bitwiseOR(1)
    places = F.array(*[(low + k * step).bitwiseAND(size - 1) for k in range(PLACES)])
    # Spark's bitmaps count from 1
    bitmaps = hashes.select(F.explode(places).alias("place")).select((F.col("place") + 1).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    with short_lived_shuffles(hashes.sparkSession):  # a task's bitmaps may be as large as the filter
        parts = stored(bitmaps).toArrow()
    bits = np.zeros(size // 8, dtype=np.uint8)
    for part, own in zip(parts.column("part").to_pylist(), parts.column("bits").to_pylist(), strict=True):
        bits[(part - 1) * (_PART // 8) : part * (_PART // 8)] = np.frombuffer(own, dtype=np.uint8)
    return Bloom(bits)
