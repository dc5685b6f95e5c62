"""Polynomial hashes of byte ranges and of word shingles, vectorised over one text."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    size = max(1 << 16, 1 << n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values in place, so that any bits of them may be used."""
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n + 1)[0][:n], out=sums[1:])
    return sums


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the `gram` bytes at each position."""
    sums = prefix_sums(data)
    return mix((sums[gram:] - sums[:-gram]) * powers(len(data) + 1)[1][: len(data) - gram + 1])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that aren't white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased.

    A text of fewer words has its whole sequence as the only shingle; one
    without words has none.
    """
    data = _LOWER[np.frombuffer(text, np.uint8)]
    start, end = word_bounds(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    w = mix((sums[end] - sums[start]) * powers(len(data) + 1)[1][start])
    size = min(words, len(w))
    total = np.zeros(len(w) - size + 1, np.uint64)
    for i in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + w[i : len(w) - size + 1 + i]
    return np.unique(mix(total + np.uint64(size)))
