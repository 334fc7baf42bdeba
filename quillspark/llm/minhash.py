"""Sets of word shingles and their min-max hash signatures."""

from __future__ import annotations

import numpy as np
import xxhash

#: Permutations; each gives its minimum and its maximum, so the signature has twice as many values.
PERMUTATIONS = 64
#: Values in a band. With 32 bands of 4 a pair at similarity 0.8 shares none with probability 5e-8.
BAND = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)
_seeds = np.random.RandomState(20240229).randint(1, 2**63 - 1, size=2 * PERMUTATIONS + 64, dtype=np.int64).astype(np.uint64)
_MULT, _ADD = _seeds[:PERMUTATIONS] | np.uint64(1), _seeds[PERMUTATIONS : 2 * PERMUTATIONS]
_PLACE = _seeds[2 * PERMUTATIONS :] | np.uint64(1)
#: Words whose hash is remembered in a worker.
MEMORY = 250_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """64-bit hashes of words, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMORY:
            self.clear()
        self[word] = h
        return h


def word_hashes(words: list[bytes], known: Words) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, of all of them if there are fewer."""
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out += (h[i : len(h) - k + 1 + i] ^ (h[i : len(h) - k + 1 + i] >> np.uint64(32))) * _PLACE[i]
    return mixed(out + np.uint64(k))


def shingles(text: bytes, k: int, known: Words) -> np.ndarray:
    """Hashes of the distinct k-word shingles of a text, sorted; with fewer words, of the whole sequence.

    A-Z are lower-cased; words are parted by space and \\x09 to \\x0D. No words: no shingles.
    """
    words = text.lower().split()
    return np.unique(rolled(word_hashes(words, known), k)) if words else np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a shingle set under each permutation, alternating."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(s), 1024):
        h = s[None, i : i + 1024] * _MULT[:, None]
        h += _ADD[:, None]
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def bands(sig: np.ndarray) -> np.ndarray:
    """One number for each band of the signature."""
    rows = sig.reshape(-1, BAND)
    out = np.zeros(len(rows), np.uint64)
    for i in range(BAND):
        out += mixed(rows[:, i] + np.uint64(i)) * _PLACE[i]
    return mixed(out + np.arange(len(rows), dtype=np.uint64) * _MIX)


def same(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
