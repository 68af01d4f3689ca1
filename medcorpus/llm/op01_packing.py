"""Packing of tokenised documents into fixed-length training sequences, best fit decreasing.

Every input partition is packed by itself, so nothing is shuffled: a partition's documents are tokenised,
overlong ones are first cut into full windows, and what is left of each is placed, longest first, into the
open sequence with the least room that still holds it. That sequence is found in a segment tree over the
2,048 possible amounts of room. Memory is bounded by ``block_tokens`` whatever the partition's size:
once a block is full it is packed, its nearly full sequences are written, and the rest are carried on into
the next block. At a partition's end the sequences that still have room are filled by cutting pieces.

Cases: a null or empty text is one end-of-document id; null ids are kept as they are; repeated rows are
packed once each; a token count above the capacity is cut; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medcorpus.llm.common import sliced, small_batches, table

CAPACITY = 2048
END_ID = 1
#: Distinct words whose ids a worker remembers; the memory is emptied when full.
WORD_MEMORY = 400_000
#: Words up to this length stay when the memory is full.
SHORT_WORD = 8
TEXTS_AT_ONCE = 200
BLOCK_TOKENS = 1 << 21
#: A sequence with no more room than this share of the capacity is written as it is.
SLACK = 0.01

#: The white space of Unicode, which ends a word for the tokenizer.
_SPACES = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_WORDS = re.compile(f"[^{_SPACES}]+").findall
#: Words of printable ASCII and Latin letters that the normaliser only lower-cases; others go through the whole tokenizer.
_LETTERS = "\xdf-\xf6\xf8-\u017f"
_PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017e]+").fullmatch
#: The pre-tokenizer's pattern on such words, lower-cased.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9]|[^a-z0-9{_LETTERS}]+").findall
#: Byte-level vocabularies write printable bytes as their own character and the others as those from 256 on.
_OWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_CHARS = {b: chr(b) for b in _OWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_OWN))}
#: str.split also splits at these, the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]").search


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of whole texts, put together from the remembered ids of their words.

    The vocabulary's pre-tokenizer drops white space and never joins text across it, so a text's ids are the
    ids of its words in order.
    """

    def __init__(self, path: str, memory: int = WORD_MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memory, self.known, self.pieces = Tokenizer.from_file(path), memory, {}, {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            split = [_WORDS(t) if _SEPARATORS(t) else t.split() for t in texts[at : at + TEXTS_AT_ONCE]]
            words = [w for own in split for w in own]
            ids = list(map(self.known.get, words))
            missing = [k for k, own in enumerate(ids) if own is None]
            if missing:
                new = self._learned(list({words[k] for k in missing}))
                for k in missing:
                    ids[k] = new[words[k]]
            end = 0
            for own in split:
                begin, end = end, end + len(own)
                yield b"".join(ids[begin:end])

    def _learned(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words, remembered from now on."""
        if len(self.known) + len(words) > self.memory:
            # long words seldom come back; if dropping them is not enough, all go
            self.known = {w: ids for w, ids in self.known.items() if len(w) <= SHORT_WORD}
            if len(self.known) > self.memory // 2:
                self.known = {}
        new, odd, piece = {}, [], self._piece
        for w in words:
            if _PLAIN(w) and "<|" not in w:
                new[w] = b"".join(map(piece, _PIECES(w.lower())))
            else:
                odd.append(w)
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            new[w] = np.array(e.ids, dtype="<u4").tobytes()
        self.known |= new
        return new

    def _piece(self, piece: str) -> bytes:
        """Ids of what the pre-tokenizer would cut out, by the vocabulary's merges alone."""
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= self.memory // 2:
                self.pieces.clear()
            chars = piece if piece.isascii() else "".join(_BYTE_CHARS[b] for b in piece.encode())
            ids = b"".join(t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(chars))
            self.pieces[piece] = ids
        return ids


class RoomTree:
    """Open sequences by their room: a segment tree of counts whose leaves are the amounts of room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, sequence: int) -> None:
        self.open.setdefault(room, []).append(sequence)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The open sequence with the least room of at least length, removed from the tree."""
        count, at = self.count, length + self.size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int, opened: list[int] = ()) -> tuple[list[int], list[int]]:
    """The sequence of each piece, and the room of each sequence; opened: room of sequences begun before."""
    tree, rooms = RoomTree(capacity), list(opened)
    for k, room in enumerate(rooms):
        if room:
            tree.add(room, k)
    placed = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            room, k = capacity, len(rooms)
            rooms.append(capacity)
        else:
            room, k = found
        rooms[k] = room - lengths[i]
        if rooms[k]:
            tree.add(rooms[k], k)
        placed[i] = k
    return placed, rooms


def fill_by_cutting(sequences: list[list], capacity: int) -> list[list]:
    """Pieces (document, start, length) of the emptiest sequences cut to fill the others; one has room at most."""
    size = lambda s: sum(p[2] for p in s)
    todo = sorted(sequences, key=size, reverse=True)
    done, low, high = [], 0, len(todo) - 1
    while low < high:
        room = capacity - size(todo[low])
        while room and todo[high]:
            doc, start, length = todo[high].pop()
            cut = min(room, length)
            todo[low].append((doc, start, cut))
            if cut < length:
                todo[high].append((doc, start + cut, length - cut))
            room -= cut
            if not todo[high] and high > low + 1:
                high -= 1
        if not todo[high]:
            high -= 1
        if not room or low >= high:
            done.append(todo[low])
            low += 1
    return done + [s for s in todo[low : high + 1] if s]


class Packer:
    """Packs one partition block by block."""

    def __init__(self, capacity: int, block_tokens: int, first: int):
        self.capacity, self.block, self.next = capacity, block_tokens, first
        self.held, self.docs, self.pieces, self.begun = 0, [], [], []

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        n, k = len(ids) // 4, len(self.docs)
        self.docs.append((doc, ids, n))
        whole = n - n % self.capacity
        for start in range(0, whole, self.capacity):
            yield from self._write([(k, start, self.capacity)])
        if whole < n:
            self.pieces.append((k, whole, n - whole))
        self.held += n
        if self.held >= self.block:
            yield from self.pack()

    def pack(self, last: bool = False) -> Iterator[tuple]:
        size = lambda s: sum(p[2] for p in s)
        begun = self.begun
        placed, rooms = best_fit_decreasing([p[2] for p in self.pieces], self.capacity, [self.capacity - size(s) for s in begun])
        begun.extend([] for _ in range(len(rooms) - len(begun)))
        for piece, k in zip(self.pieces, placed, strict=True):
            begun[k].append(piece)
        slack = int(SLACK * self.capacity)
        for s, room in zip(begun, rooms, strict=True):
            if room <= slack:
                yield from self._write(s)
        rest = [s for s, room in zip(begun, rooms, strict=True) if room > slack]
        if last or sum(map(size, rest)) > self.block // 2:
            rest = fill_by_cutting(rest, self.capacity)
            keep = [] if last else [s for s in rest if size(s) < self.capacity]
            for s in rest:
                if last or size(s) == self.capacity:
                    yield from self._write(s)
            rest = keep
        used = {p[0]: None for s in rest for p in s}
        new = {old: k for k, old in enumerate(used)}
        self.docs = [self.docs[old] for old in used]
        self.begun = [[(new[d], a, n) for d, a, n in s] for s in rest]
        self.pieces, self.held = [], sum(size(s) for s in rest)

    def _write(self, pieces: list) -> Iterator[tuple]:
        at, sequence = 0, self.next
        self.next += 1
        for k, start, length in pieces:
            doc, ids, n = self.docs[k]
            own = ids[4 * start : 4 * (start + length)]
            yield doc, start, length, zlib.crc32(own), n, sequence, at, own
            at += length


def _pack_partition(batches, tokenizer: str, capacity: int, end_id: int, block_tokens: int, with_ids: bool):
    context = TaskContext.get()
    packer = Packer(capacity, block_tokens, (context.partitionId() if context else 0) << 32)
    words, end = WordTokenizer(tokenizer), np.array([end_id], dtype="<u4").tobytes()

    def rows(found: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True))
        arrays = [pa.array(cols[0], type=id_type)] + [pa.array(c, type=pa.int64()) for c in cols[1:7]]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            values = np.frombuffer(b"".join(cols[7]), dtype="<u4").astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in cols[7]])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    out, id_type = [], pa.int64()
    for batch in sliced(batches):
        id_type = batch.schema.field(0).type
        docs = batch.column(0).to_pylist()
        for doc, ids in zip(docs, words.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
            out.extend(packer.add(doc, ids + end))
            if len(out) >= 500:
                yield rows(out, id_type)
                out = []
    out.extend(packer.pack(last=True))
    if out:
        yield rows(out, id_type)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _pack_partition(it, tokenizer, capacity, end_id, block_tokens, with_ids), schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op1_packing": op1_packing}
ORACLE_SQL: dict[str, str] = {}
