"""Word-shingle sets of texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_CACHE_ENTRIES = 100_000
_SEED = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word bytes to a 64-bit hash, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= _CACHE_ENTRIES:
            self.clear()
        if len(word) <= 40:
            self[word] = h
        return h


_WORDS = WordHashes()


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of ``[^\\x20\\x09-\\x0D]+`` (which is what bytes.split() cuts at)."""
    words = data.split()
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; with fewer words, of the whole sequence; empty without words.

    Only A-Z are lower-cased.
    """
    h = word_hashes(text.encode().lower()) if text else np.zeros(0, dtype=np.uint64)
    n = len(h)
    if n == 0:
        return h
    span = min(n, size)
    out = np.full(n - span + 1, span, dtype=np.uint64) * _SEED
    for k in range(span):
        out = (out ^ h[k : n - span + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(mixed(out))
