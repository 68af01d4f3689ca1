"""Token counts by rank-synchronous merging of ragged arrays.

The distinct words of a batch of texts are cut into the tokenizer's pre-tokens, and all pre-tokens that a worker does not remember
are held as one ragged numpy array of symbol ids. Each round looks up the rank of every pair of neighbours, takes
the lowest rank of each sequence, and merges all its places at once, from the left where they overlap; sequences without a pair
that can be merged leave the array with the number of symbols that they have left. That is what merging one pair after
another gives, as long as every merge comes after those that make its parts, which is checked when the vocabulary is read.

Nothing is shuffled; a worker holds one slice of texts, and the counts of at most ``MEMORY`` words.

Cases: a null text is empty and has no tokens; special strings inside a text are one token each, found before anything else, as the library
does; very long texts are read whole; rows are counted one by one, so repeated rows and equal ids make no difference, and a
null id is kept; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medcorpus.llm.common import sliced, small_batches, table
from medcorpus.llm.op01_packing import _BYTE_CHARS, _PIECES, _PLAIN, _SPACES, default_tokenizer

LIMIT = 2048
#: Words, or pre-tokens, whose counts a worker remembers; the memory is emptied when full.
MEMORY = 400_000
#: Symbols that are merged at once.
SYMBOLS = 1 << 20
_NEVER = np.int64(1 << 40)


class MergeTable:
    """The merges of a byte-level vocabulary in the JSON format of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, vocab = said["model"], said["model"]["vocab"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level merges can be counted")
        self.tokenizer, end = Tokenizer.from_file(path), model.get("end_of_word_suffix") or ""
        self.first = np.array([vocab[_BYTE_CHARS[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[_BYTE_CHARS[b] + end] for b in range(256)], dtype=np.int64)
        parts = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in col], dtype=np.int64) for col in zip(*((a, b, a + b) for a, b in parts), strict=True))
        rank = np.arange(len(parts))
        since = np.full(max(vocab.values()) + 1, -1)
        since[made[::-1]] = rank[::-1]
        if np.any(since[left] >= rank) or np.any(since[right] >= rank):
            raise ValueError("a merge comes before one that makes its parts")
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], rank[order], made
        special = [t["content"] for t in said.get("added_tokens", [])]
        if any(t.get(k) for t in said.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("special strings must stand for themselves")
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        #: Pre-tokens never hold white space, so that words can be counted apart.
        self.words_apart = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("a b")] == ["a", "b"]
        self.bytes_of = {c: b for b, c in _BYTE_CHARS.items()}

    def pre_tokens(self, text: str) -> list[bytes]:
        """Pre-tokens of a text without special strings."""
        if self.words_apart and _PLAIN(text):
            return [p.encode() for p in _PIECES(text.lower())]
        plain = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [bytes(map(self.bytes_of.__getitem__, p)) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; _NEVER where none merges it."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], _NEVER)


def surviving(symbols: np.ndarray, lengths: np.ndarray, merges: MergeTable) -> np.ndarray:
    """How many symbols of each sequence (none is empty) are left when nothing can be merged."""
    out, own, lengths = np.zeros(len(lengths), dtype=np.int64), np.arange(len(lengths)), lengths.copy()
    while len(own):
        starts = np.cumsum(lengths) - lengths
        rank = np.full(len(symbols), _NEVER)
        rank[:-1] = merges.ranks(symbols[:-1], symbols[1:])
        rank[starts + lengths - 1] = _NEVER
        least = np.minimum.reduceat(rank, starts)
        some = least < _NEVER
        out[own[~some]] = lengths[~some]
        if not some.all():
            stay = np.repeat(some, lengths)
            symbols, rank, own, lengths, least = symbols[stay], rank[stay], own[some], lengths[some], least[some]
            if not len(own):
                break
        hit = rank == np.repeat(least, lengths)
        # of pairs that overlap, as in a run of one symbol, every second one
        place = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, 0))
        hit &= (place - run) % 2 == 0
        symbols = np.where(hit, merges.made[np.where(hit, rank, 0)], symbols)
        gone = np.concatenate([[False], hit[:-1]])
        seq = np.repeat(np.arange(len(lengths)), lengths)
        lengths = lengths - np.bincount(seq[gone], minlength=len(lengths))
        symbols = symbols[~gone]
    return out


class TokenCounter:
    """Counts of whole texts, from the remembered counts of their words or pre-tokens."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.merges, self.memory, self.known, self.words = MergeTable(path), memory, {}, {}

    def _merged(self, new: list[bytes]) -> dict[bytes, int]:
        found, at = {}, 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and (end == at or size + len(new[end]) <= SYMBOLS):
                size += len(new[end])
                end += 1
            own = new[at:end]
            lengths = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
            data = np.frombuffer(b"".join(own), dtype=np.uint8)
            symbols, last = self.merges.first[data], np.cumsum(lengths) - 1
            symbols[last] = self.merges.last[data[last]]
            found |= zip(own, surviving(symbols, lengths, self.merges).tolist(), strict=True)
            at = end
        return found

    def _of(self, texts: list[str]) -> list[int]:
        """Counts of texts, whatever they hold."""
        special = self.merges.special
        cut = [[], []]
        for t in texts:
            parts = special.split(t) if special and special.search(t) else [t]
            cut[0].append(len(parts) - 1)
            cut[1].append([p for part in parts if part for p in self.merges.pre_tokens(part)])
        known = self.known
        if len(known) > self.memory:
            known.clear()
        known |= self._merged(list({p: None for own in cut[1] for p in own if p not in known}))
        return [n + sum(map(known.__getitem__, own)) for n, own in zip(*cut, strict=True)]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; none is null."""
        if not self.merges.words_apart:
            return np.array(self._of(texts.to_pylist()), dtype=np.int64)
        words = pc.split_pattern_regex(texts.cast(pa.large_string()), f"[{_SPACES}]+")
        coded = words.flatten().dictionary_encode()
        distinct, known = coded.dictionary.to_pylist(), self.words
        counts = [known.get(w) for w in distinct]
        missing = [k for k, n in enumerate(counts) if n is None]
        if missing:
            if len(known) + len(missing) > self.memory:
                known.clear()
            for k, n in zip(missing, self._of([distinct[k] for k in missing]), strict=True):
                counts[k] = known[distinct[k]] = n
        sums = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64)[coded.indices.to_numpy()])]) if len(coded) else np.zeros(1, dtype=np.int64)
        return np.diff(sums[words.offsets.to_numpy() - words.offsets[0].as_py()])


def _counted(batches, tokenizer: str, limit: int) -> Iterator[pa.RecordBatch]:
    counter = TokenCounter(tokenizer)
    for batch in sliced(batches):
        texts = pc.fill_null(batch.column(1), "")
        n = counter.count(texts)
        yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) per row of docs; tokenizer: the vocabulary's file, on all executors."""
    small_batches(docs.sparkSession)
    tokenizer, kind = tokenizer or default_tokenizer(), dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _counted(it, tokenizer, limit), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op11_token_counts": op11_token_counts}
#: A vocabulary's merges are beyond SQL; tests/llm/test_op11.py compares with the library.
ORACLE_SQL: dict[str, str] = {}
