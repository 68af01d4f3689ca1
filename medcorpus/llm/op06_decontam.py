"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with up to k = floor(m * error) edits. Cut into k + 1 pieces, at least one
piece of such an occurrence is unchanged. All pieces of all items are found in one Aho-Corasick pass over each
document; every hit names an item and a place, hits of one item at nearby places are one window, and in each window
Myers' bit-parallel distance decides and gives the window's best occurrence. The search is exact: every document and item
with an occurrence within the budget is found. By default a document's best occurrence of an item is returned; with ``every``
all that do not overlap are, best first, one for each window.

Text is compared lower-cased with white space as blanks, one character for one, so places are those of the document.

The items are the stated query set: they go to the executors in blocks of at most ``BLOCK_CHARS`` characters, and the
documents are read once for each block. The driver holds one block at a time; if there are more, what a block finds is stored
before the next is read. Documents are neither shuffled nor collected.

Cases: null and empty items match nothing; items shorter than ``MIN_CHARS`` match only as they are (no edits); a null
or empty document has no match; very long texts are searched whole; of occurrences of equal distance the first counts; repeated
rows are matched once each; repeated items give a row each; item ids must be integers; other columns are never read, whatever
their names; an empty table of either kind gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medcorpus.llm.common import sliced, small_batches, stored, table

ERROR = 0.08
MIN_CHARS = 30
BLOCK_CHARS = 4_000_000
_ODD_SPACE = {c: " " for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}
_has_odd_space = re.compile("[" + "".join(map(chr, _ODD_SPACE)) + "]").search


def plain(text: str) -> str:
    """text lower-cased and with blanks for white space, character by character."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    for c in "\n\t\r\v\f":
        low = low.replace(c, " ")
    return low if low.isascii() or not _has_odd_space(low) else low.translate(_ODD_SPACE)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of almost equal length, with their places."""
    cuts = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, item: str):
        self.m, self.mask, self.last, self.bits = len(item), (1 << len(item)) - 1, 1 << (len(item) - 1), {}
        for k, c in enumerate(item):
            self.bits[c] = self.bits.get(c, 0) | 1 << k

    def best_end(self, text: str, free_start: bool = True) -> tuple[int, int]:
        """(distance, end) of the best occurrence of the item that ends in text; the first of equals."""
        pv, mv, score, best = self.mask, 0, self.m, (self.m, 0)
        bits, mask, last, carry = self.bits, self.mask, self.last, 0 if free_start else 1
        for at, c in enumerate(text, 1):
            eq = bits.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & mask)
            mh = pv & xh
            if ph & last:
                score += 1
            elif mh & last:
                score -= 1
            ph = ((ph << 1) | carry) & mask
            pv = ((mh << 1) & mask) | (~(xv | ph) & mask)
            mv = ph & xv
            if score < best[0]:
                best = (score, at)
        return best


class Matcher:
    """Finds items in documents."""

    def __init__(self, items: list[tuple[int, str]], error: float, min_chars: int):
        self.items, self.automaton = [], ahocorasick.Automaton()
        at: dict[str, list] = {}
        for item_id, text in items:
            text = plain(text or "").strip()
            if text:
                edits = int(len(text) * error) if len(text) >= min_chars else 0
                k = len(self.items)
                self.items.append((item_id, text, edits, Pattern(text), Pattern(text[::-1])))
                for place, piece in pieces(text, edits):
                    at.setdefault(piece, []).append((k, place))
        for piece, owners in at.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if self.items:
            self.automaton.make_automaton()

    def find(self, text: str, every: bool = False) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) of the best occurrence of each item within its budget, or of every one that overlaps no better."""
        if not self.items or not text:
            return []
        low, hits = plain(text), {}
        for end, (length, owners) in self.automaton.iter(low):
            for k, place in owners:
                hits.setdefault(k, []).append(end + 1 - length - place)
        found = []
        for k, starts in hits.items():
            item_id, item, edits, pattern, reverse = self.items[k]
            own, done = [], -1
            starts.sort()
            i = 0
            while i < len(starts):
                # one window for the run of hits whose windows overlap
                a = max(0, starts[i] - edits, done)
                j = i
                while j + 1 < len(starts) and starts[j + 1] - starts[j] <= 2 * edits:
                    j += 1
                b = min(len(low), starts[j] + len(item) + edits)
                i = bisect_right(starts, starts[j], lo=j)
                distance, end = pattern.best_end(low[a:b])
                if distance <= edits and (every or not own or distance < own[0][0]):
                    tail = low[max(0, a + end - len(item) - edits) : a + end][::-1]
                    hit = (distance, a + end - reverse.best_end(tail)[1], a + end)
                    own = [*own, hit] if every else [hit]
            kept: list[tuple[int, int, int]] = []
            for hit in sorted(own):
                if all(hit[2] <= x[1] or x[2] <= hit[1] for x in kept):
                    kept.append(hit)
            found += [(item_id, b, e, d) for d, b, e in kept]
        return found


def _match(batches, items, error: float, min_chars: int, every: bool):
    matcher = Matcher(items, error, min_chars)
    for batch in sliced(batches):
        rows = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matcher.find(text or "", every)]
        if rows:
            types = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "item_id", "start", "end", "distance"])


def _blocks(items: DataFrame, block_chars: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """The number of blocks of about block_chars characters of items(item_id, text), one at least, and the blocks one after another."""
    small_batches(items.sparkSession)
    items = items.select(F.col("item_id").cast("long"), "text").filter("length(text) > 0")
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, ([tuple(r) for r in items.filter(part == k).orderBy("item_id", "text").collect()] for k in range(n))


def find_contamination(docs: DataFrame, items: DataFrame, error: float = ERROR, min_chars: int = MIN_CHARS, every: bool = False, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start, end, distance: the best occurrence of each item(item_id, text) in each document that has one, or every one."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(base.dtypes)['doc_id']}, item_id long, start long, end long, distance long"
    n, blocks = _blocks(items, block_chars)
    found = (base.mapInArrow(lambda it, own=own: _match(it, own, error, min_chars, every), schema) for own in blocks)
    return next(found) if n == 1 else reduce(DataFrame.unionByName, map(stored, found))


def drop_contaminated(docs: DataFrame, items: DataFrame, error: float = ERROR, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS, text_col: str = "text") -> DataFrame:
    """The rows of docs in which no item occurs, all their columns unchanged."""
    n, blocks = _blocks(items, block_chars)
    for own in blocks:
        docs = docs.filter(_is_clean(own, error, min_chars)(F.col(text_col)))
        docs = docs if n == 1 else stored(docs)
    return docs


def _is_clean(items: list[tuple[int, str]], error: float, min_chars: int):
    """A function of a text column: no item occurs."""

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(items, error, min_chars)
        for texts in batches:
            yield pd.Series([not matcher.find(t or "") for t in texts], index=texts.index)

    return clean


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontam": op6_decontam}
ORACLE_SQL: dict[str, str] = {}
