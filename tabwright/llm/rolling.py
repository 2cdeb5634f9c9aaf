"""Polynomial prefix hashes of byte strings, in whole arrays.

``PrefixHash(data)`` answers the hash of any slice of ``data`` in constant
time: sums of table[byte] * r**place, with the place divided out again. Words
and shingles of a text are hashed from one such table.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
_TABLE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i for i up to n, kept for the next call."""
    have = len(_POWERS[0])
    if have <= n:
        size = max(n + 1, 2 * have, 1 << 14)
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PrefixHash:
    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each slice; equal slices of equal length have equal hashes."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def raw_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes other than ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word, A-Z lower-cased."""
    data = _LOWER[raw_bytes(text)]
    starts, ends = word_bounds(data)
    return PrefixHash(data).of(starts, ends)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of so many words.

    A text of fewer words has its whole sequence as one shingle; one without
    words has none.
    """
    h = word_hashes(text)
    if not len(h):
        return h
    size = min(words, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[i : i + n])
    return np.unique(out)
