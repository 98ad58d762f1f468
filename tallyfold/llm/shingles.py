"""Words, word shingles and their MinHash signatures, inside of a task."""

from __future__ import annotations

import re

import numpy as np
import xxhash

SHINGLE_WORDS = 5
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hash a worker remembers before it starts afresh.
_CACHE = 200_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _Hashes()


def forget() -> None:
    """Give the memory back at the end of a task."""
    _HASHES.clear()


def hashes_of(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, one by one."""
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str) -> list[str]:
    """Words with A-Z in lower case; white space is the space and U+0009 to U+000D."""
    return _WORD.findall(text.translate(_LOWER))


def shingle_set(words: list[str], size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words make one shingle."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = hashes_of(words)
    k = min(size, len(h))
    with np.errstate(over="ignore"):
        s = h[: len(h) - k + 1] ^ np.uint64(k)
        for j in range(1, k):
            s = (s ^ (s >> np.uint64(31))) * _MIX + h[j : len(h) - k + 1 + j]
        s ^= s >> np.uint64(32)
    return np.unique(s)


class MinHash:
    """Universal hashes x -> (a x + b) mod 2^64, top 32 bits; a odd, drawn once from a seed."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = bands * rows
        self.bands, self.rows = bands, rows
        self._a = rng.integers(0, 2**63, n, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self._b = rng.integers(0, 2**64, n, dtype=np.uint64, endpoint=False)[:, None]

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self._a), np.iinfo(np.uint64).max, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(shingles), 2048):  # bounded memory for very long texts
                part = self._a * shingles[None, at : at + 2048]
                part += self._b
                np.minimum(least, part.min(axis=1), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key per band; the band's number is part of the key."""
        rows = minima.reshape(self.bands, self.rows)
        return np.array([xxhash.xxh64_intdigest(r.tobytes(), seed=i) for i, r in enumerate(rows)], dtype=np.uint64).view(np.int64)


def sketch(minima: np.ndarray) -> bytes:
    """The lowest byte of every minimum: equal bytes estimate similarity (1/256 by chance)."""
    return minima.astype(np.uint8).tobytes()
