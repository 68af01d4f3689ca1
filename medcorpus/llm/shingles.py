"""Word shingles as sorted 64-bit hashes, and MinHash signatures of them."""

from __future__ import annotations

import hashlib
import re

import numpy as np

_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
find_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def lowered(text: str) -> str:
    """A-Z lower-cased, all else unchanged."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def mixed(x: np.ndarray) -> np.ndarray:
    """x with its bits spread, one to one."""
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    x = (x ^ (x >> np.uint64(29))) * _MIX[2]
    return x ^ (x >> np.uint64(32))


_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    """Odd 64-bit powers, one for each place in a word."""
    if n > len(_powers.known):
        _powers.known = np.cumprod(np.full(2 * n, _MIX[0], dtype=np.uint64))
    return _powers.known


_powers.known = np.cumprod(np.full(64, _MIX[0], dtype=np.uint64))


def word_hashes(text: str, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word of text (find_words), with A-Z lower-cased if asked for."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    if not len(edges):
        return np.zeros(0, dtype=np.uint64)
    lengths = edges[1::2] - edges[::2]
    begins = np.cumsum(lengths) - lengths
    own = data[inside]
    place = np.arange(len(own)) - np.repeat(begins, lengths)
    sums = np.add.reduceat(_BYTE[own] * _powers(int(lengths.max()))[place], begins)
    return mixed(sums + lengths.astype(np.uint64))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size words; of all words if they are fewer."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = out * _MIX[0] + words[k : n + k]
        out ^= out >> np.uint64(29)
    return mixed(out)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text, A-Z lower-cased."""
    return np.unique(gram_hashes(word_hashes(text or "", lower=True), size))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class MinHasher:
    """Signatures of n_hashes 8-bit values; unlike documents agree in one of 256 by chance."""

    def __init__(self, n_hashes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 31, n_hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, n_hashes, dtype=np.uint32)[:, None]

    def sign(self, shingles: np.ndarray) -> bytes:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = None
        for at in range(0, len(x), 1024):
            own = (x[None, at : at + 1024] * self.a + self.b).min(axis=1)
            least = own if least is None else np.minimum(least, own)
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()
