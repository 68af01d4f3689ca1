"""Substring deduplication by prefix-partitioned suffix trees of words.

A window of 13 words is repeated if a document with a smaller doc_id has it too. The trees hold the suffixes that begin
at anchors: a window's anchor is the run of ``PREFIX`` words in it with the smallest hash, so equal windows have the same
anchor at the same place, and the other suffixes need not be moved. Each suffix carries the words to its left that a
window can reach, and ends a window after its anchor.

1. Anchors that a single text has cannot be part of a repeat: their prefix leads to a leaf. They are found by
   counting, pre-aggregated, and left out.
2. The other suffixes are dealt by their prefix, so each group is a subtree. A prefix too frequent for one task is
   lengthened by a word; if it is still too frequent, its suffixes are dealt over several partial subtrees, of which
   each node names its first document, and those are compared once more. Groups follow one another in a
   sorted stream, and a task holds about ``CHUNK`` suffixes at a time.
3. A subtree is its sorted suffixes with the lengths of their neighbours' common prefixes; an internal node of depth d is a
   run of suffixes that share d words or more with their neighbours. The words on the left, read backwards, make a second
   tree in the same way. Two windows that begin j words before their anchors are equal if their suffixes are below
   one node of depth 13 - j of the first tree and one of depth j of the second: every window whose document is
   not the first there is repeated. A maximal repeat of more than 13 words is the union of its windows.

A text that equals that of a smaller doc_id is a repeat as a whole and needs no tree; such texts are found by their MD5, and
by the text itself where rows share a doc_id. Words are compared as 32-bit codes beside the 64-bit hash of the anchor.

Cases: a null or empty text has no words; texts shorter than a window lose nothing; repeats inside one document
do not count; very long texts are more suffixes, dealt like all others; rows that share a doc_id are each judged by themselves
and never repeat one another; a null doc_id neither repeats nor is repeated; ids must be integers; other columns are
never read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medcorpus.llm.common import sliced, small_batches, table
from medcorpus.llm.shingles import find_words, gram_hashes, mixed, word_hashes

WINDOW, PREFIX = 13, 5
#: Runs of PREFIX words in a window, and the words kept on the left of an anchor.
RUNS = WINDOW - PREFIX + 1
#: Suffixes that a group may hold, and that a task sorts at a time.
GROUP_ROWS, CHUNK = 8_000, 200_000
_BLANK = np.iinfo(np.int64).min


def anchor_hashes(runs: np.ndarray) -> np.ndarray:
    """The smallest hash among each window's runs of PREFIX words."""
    out, width = runs, 1
    while width < RUNS:
        step = min(width, RUNS - width)
        out, width = np.minimum(out[:-step], out[step:]), width + step
    return out.view(np.int64)


def _text_key(text: str) -> int:
    """31 bits that tell rows of one doc_id apart."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") >> 1


def _anchor_rows(batches):
    """(doc_id, text) -> each document's distinct anchors and how often they occur in it."""
    for batch in sliced(batches):
        ids, hashes, counts = batch.column(0).to_pylist(), [], []
        for text in batch.column(1).to_pylist():
            words = word_hashes(text or "")
            own = anchor_hashes(gram_hashes(words, PREFIX)) if len(words) >= WINDOW else np.zeros(0, dtype=np.int64)
            begin = np.flatnonzero(np.diff(own, prepend=~own[:1]))
            run = np.diff(begin, append=len(own))
            # one place serves RUNS windows at most; a longer run of one hash is text that repeats itself, place after place
            places = np.where(run > RUNS, run, 1)
            own, at = np.unique(own[begin], return_inverse=True)
            n = np.bincount(at, places, len(own))
            hashes.append(own)
            counts.append(n)
        if any(map(len, hashes)):
            docs = np.repeat(np.array(ids, dtype=np.int64), list(map(len, hashes)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(docs), pa.array(np.concatenate(counts).astype(np.int32))], names=["h", "doc_id", "times"])


def _suffix_rows(batches):
    """(doc_id, text, repeated anchors with their salts) -> suffixes at repeated anchors with their left words."""
    left, width = RUNS - 1, RUNS - 1 + WINDOW
    names = ["h", "salt", "doc_id", "at", "lo", "hi", "words"]

    def out(parts):
        cols = [np.concatenate([p[k] for p in parts]) for k in range(6)]
        data = np.concatenate([p[6] for p in parts])
        words = pa.Array.from_buffers(pa.binary(4 * width), len(data), [None, pa.py_buffer(np.ascontiguousarray(data))])
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), words.cast(pa.binary())], names=names)

    for batch in sliced(batches):
        parts, n = [], 0
        for doc, text, found, salts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            hashes = word_hashes(text or "")
            if len(hashes) < WINDOW:
                continue
            runs = gram_hashes(hashes, PREFIX)
            h = anchor_hashes(runs)
            found, order = np.unique(np.array(found, dtype=np.int64), return_index=True)
            salts = np.array(salts, dtype=np.int64)[order]
            place = np.minimum(np.searchsorted(found, h), len(found) - 1)
            windows = np.flatnonzero(found[place] == h)
            if not len(windows):
                continue
            # the first place of the smallest hash in each window
            at = np.lib.stride_tricks.sliding_window_view(runs, RUNS)[windows].argmin(axis=1) + windows
            # one row for the windows that share an anchor: they follow one another
            first = np.concatenate([[True], at[1:] != at[:-1]])
            begin = np.nonzero(first)[0]
            end = np.concatenate([begin[1:], [len(windows)]]) - 1
            centre = at[begin]
            codes = np.zeros(left + len(hashes) + WINDOW, dtype=np.uint32)
            codes[left : left + len(hashes)] = (hashes >> np.uint64(32)).astype(np.uint32)
            own = salts[place[windows[begin]]]
            right = np.lib.stride_tricks.sliding_window_view(codes, width)[centre]
            salt = (mixed(np.uint64(doc & (2**63 - 1)) + centre.astype(np.uint64)) >> np.uint64(1)).astype(np.int64) % own
            key, low, high = h[windows[begin]], (centre - windows[end]).astype(np.int32), (centre - windows[begin]).astype(np.int32)
            base, doc_ids = _text_key(text) << 32, np.full(len(begin), doc, dtype=np.int64)
            hot, reach = own > 1, RUNS - 2
            if hot.any():
                # a longer prefix, the anchor's words and the next, for the windows that hold that word; the others keep the short one
                short = hot & (high > reach)
                parts.append((key[short], salt[short] + (1 << 41), doc_ids[short], base + centre[short], np.maximum(low, reach + 1)[short], high[short], right[short]))
                key = np.where(hot, _row_hash(right[:, left : left + PREFIX + 1]), key)
                high = np.where(hot, np.minimum(high, reach), high).astype(np.int32)
            keep = low <= high
            parts.append((key[keep], (salt + (hot.astype(np.int64) << 40))[keep], doc_ids[keep], (base + centre)[keep], low[keep], high[keep], right[keep]))
            n += len(begin)
            if n >= 50_000:
                yield out(parts)
                parts, n = [], 0
        if parts:
            yield out(parts)


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of 32-bit codes."""
    out = np.full(len(rows), 17, dtype=np.uint64)
    for k in range(rows.shape[1]):
        out = mixed(out * np.uint64(31) + rows[:, k].astype(np.uint64))
    return out.view(np.int64)


def sorted_suffixes(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of words within their groups, and each one's common prefix with the row before it (-1: other group)."""
    n, width = words.shape
    even = np.zeros((n, width + width % 2), dtype=np.uint64)
    even[:, :width] = words
    pairs = even[:, ::2] << np.uint64(32) | even[:, 1::2]
    order = np.lexsort((*pairs.T[::-1], group))
    differ = words[order[1:]] != words[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate([[-1], common])


def nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each row, the number of its node of this depth."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def _subtrees(batches):
    """Rows sorted by (h, salt) -> repeated windows as ranges of words; node is set where a split group's first document is named."""
    left, width = RUNS - 1, RUNS - 1 + WINDOW
    held: list[list[np.ndarray]] = []

    def repeats(cols: list[np.ndarray]):
        h, salt, doc, at, lo, hi, codes = cols
        group = np.concatenate([[0], np.cumsum((h[1:] != h[:-1]) | (salt[1:] != salt[:-1]))])
        hot = salt >= 1 << 40
        found = [[], [], [], []]
        right = sorted_suffixes(group, codes[:, left:])
        before = sorted_suffixes(np.zeros(len(group), dtype=np.int64), codes[:, :left][:, ::-1])
        for j in range(RUNS):
            # windows that begin j words before their anchor
            k = np.nonzero((lo <= j) & (j <= hi))[0]
            if not len(k):
                continue
            node = nodes(*right, WINDOW - j)[k] * (len(group) + 1) + nodes(*before, j)[k]
            order = np.lexsort((doc[k], node))
            k, node = k[order], node[order]
            begin = np.concatenate([[True], node[1:] != node[:-1]])
            first = doc[k][begin][np.cumsum(begin) - 1]
            later = doc[k] > first
            rows = k[later]
            for c, v in zip(found, (doc[rows], at[rows] - j, at[rows] - j + WINDOW, np.full(len(rows), _BLANK)), strict=True):
                c.append(v)
            rows = k[~later & hot[k]]
            if len(rows):
                label = _row_hash(codes[rows, left - j : left - j + WINDOW])
                for c, v in zip(found, (doc[rows], at[rows] - j, at[rows] - j + WINDOW, np.where(label == _BLANK, 0, label)), strict=True):
                    c.append(v)
        doc, a, b, label = (np.concatenate(c) for c in found)
        order = np.lexsort((a, doc, label))
        doc, a, b, label = doc[order], a[order], b[order], label[order]
        # ranges that touch become one, but for those of named nodes
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (a[1:] > b[:-1]) | (label[1:] != _BLANK)]) if len(doc) else np.zeros(0, dtype=bool)
        begin = np.nonzero(new)[0]
        end = np.concatenate([begin[1:], [len(doc)]])[: len(begin)] - 1
        return pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(a[begin]), pa.array(b[end]), pa.array(label[begin], mask=label[begin] == _BLANK)], names=["doc_id", "start", "end", "node"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        words = np.frombuffer(b"".join(batch.column(6).to_pylist()), dtype=np.uint32).reshape(-1, width)
        held.append([*cols, words])
        if sum(len(c[0]) for c in held) >= CHUNK:
            cols = [np.concatenate([p[k] for p in held]) for k in range(7)]
            last = np.nonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[0]
            if len(last):
                cut = last[-1] + 1
                yield repeats([c[:cut] for c in cols])
                cols = [c[cut:] for c in cols]
            held = [cols]
    if held:
        yield repeats([np.concatenate([p[k] for p in held]) for k in range(7)])


def _cut(batches, with_text: bool):
    """(doc_id, text, copy, starts, ends) -> what is left of each document."""
    for batch in sliced(batches):
        rows = []
        for doc, text, copy, starts, ends in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            text = text or ""
            words = find_words(text)
            n = len(words)
            if copy and n >= WINDOW:
                words = []
            elif starts:
                base = _text_key(text) << 32
                gone = np.zeros(n + 1, dtype=np.int32)
                own = [(a - base, b - base) for a, b in zip(starts, ends, strict=True) if 0 <= a - base < n]
                for a, b in own:
                    gone[a] += 1
                    gone[b] -= 1
                kept = np.nonzero(np.cumsum(gone[:-1]) == 0)[0]
                words = [words[k] for k in kept]
            left = " ".join(words)
            rows.append((doc, n, n - len(words), hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest(), *([left] if with_text else [])))
        if rows:
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), *[pa.string()] * with_text]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[str(k) for k in range(len(types))])


def drop_repeats(docs: DataFrame, with_text: bool = True, group_rows: int = GROUP_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the text that is left, per row of docs."""
    small_batches(docs.sparkSession)
    # a bare column where it can be: behind an alias Spark would not see that the shuffled texts are the same in every branch
    own_id = F.col(id_col) if (id_col, dict(docs.dtypes)[id_col]) == ("doc_id", "bigint") else F.col(id_col).cast("long").alias("doc_id")
    base = docs.select(own_id, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = base.filter("doc_id is not null")
    equal = texts.select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"))
    first = equal.groupBy("m").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("m", "first")
    copies = equal.join(first, "m").filter("doc_id > first").select("doc_id", F.unhex("m").alias("m"))
    # a doc_id's other rows are no copies: the text is compared as well
    own = texts.join(copies.groupBy("doc_id").agg(F.collect_set("m").alias("ms")), "doc_id", "left")
    is_copy: Column = F.coalesce(F.array_contains("ms", F.unhex(F.md5(F.col("text").cast("binary")))), F.lit(False))
    marked = own.select("doc_id", "text", is_copy.alias("copy"))
    found = marked.filter("not copy").select("doc_id", "text").mapInArrow(_anchor_rows, "h long, doc_id long, times int")
    salts = F.ceil(F.col("n") / group_rows).cast("int")
    twice = found.groupBy("h").agg(F.count("*").alias("docs"), F.sum("times").alias("n")).filter("docs > 1").select("h", salts.alias("salts"))
    repeated = found.select("h", "doc_id").join(twice, "h").groupBy("doc_id").agg(F.collect_list(F.struct("h", "salts")).alias("found"))
    suffixes = marked.filter("not copy").join(repeated, "doc_id").select("doc_id", "text", F.col("found.h").alias("h"), F.col("found.salts").alias("salts"))
    suffixes = suffixes.mapInArrow(_suffix_rows, "h long, salt long, doc_id long, at long, lo int, hi int, words binary")
    spans = suffixes.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_subtrees, "doc_id long, start long, end long, node long")
    named = spans.filter("node is not null")
    # a node of a split group has one document for each of its salts
    firsts = named.groupBy("node").agg(F.min("doc_id").alias("first"), F.collect_list(F.struct("doc_id", "start", "end")).alias("own"))
    later = firsts.select("first", F.explode("own").alias("r")).filter("r.doc_id > first").select("r.doc_id", "r.start", "r.end")
    ranges = spans.filter("node is null").select("doc_id", "start", "end").unionByName(later)
    ranges = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    done = marked.join(ranges, "doc_id", "left").select("doc_id", "text", "copy", F.col("ranges.start").alias("starts"), F.col("ranges.end").alias("ends"))
    rest = base.filter("doc_id is null").select("doc_id", "text", F.lit(False).alias("copy"), F.lit(None).cast("array<long>").alias("starts"), F.lit(None).cast("array<long>").alias("ends"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return done.unionByName(rest).mapInArrow(lambda it: _cut(it, with_text), schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLE_SQL = {
    "op4_substring_dedup": r"""with d as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
    x as (select rid, doc_id, unnest(range(1, len(w) - 11)) p, w from d), y as (select rid, doc_id, p, w[p:p+12] s from x),
    f as (select s, min(doc_id) first from y group by s), hit as (select rid, p from y join f using (s) where doc_id > first),
    gone as (select rid, list(distinct p + k) g from hit, range(0, 13) t(k) group by rid),
    kept as (select doc_id, len(w) n, list_filter(w, lambda v, i: not list_contains(coalesce(g, []), i)) k from d left join gone using (rid))
    select doc_id, n as n_words, n - len(k) as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept"""
}
