"""Hashes of words and word shingles, and MinHash signatures, as whole-text array operations.

A word is a run of letters, digits and characters beyond ASCII of the lower-cased text. Its hash
is a difference of prefix sums of a polynomial over the UTF-8 bytes, modulo 2**64, mixed; equal
words hash alike in every process.
"""

from __future__ import annotations

import numpy as np

SHINGLE_WORDS = 5

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True
_WORD_BYTE[128:] = True
_STEP = _rng.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones((2, 1), np.uint64)


def _pow(n: int) -> np.ndarray:
    """Powers of the base and of its inverse, n of each at least."""
    global _powers
    if _powers.shape[1] < n:
        size = max(n, 2 * _powers.shape[1], 1 << 14)
        grown = np.ones((2, size), np.uint64)
        grown[0, 1:], grown[1, 1:] = _BASE, _INVERSE
        _powers = np.cumprod(grown, axis=1, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """The hash of each word, in order."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD_BYTE[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    powers = _pow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[0, : len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers[1, starts])


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of all runs of SHINGLE_WORDS words; a shorter text is one shingle,
    a text without words has none."""
    words = word_hashes(text)
    n = max(min(len(words), 1), len(words) - SHINGLE_WORDS + 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE_WORDS, len(words))):
        total += words[j : j + n] * _STEP[j]
    return np.unique(mix(total))


class MinHasher:
    """Signatures of ``size`` 32-bit minima."""

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, (size, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, (size, 1), dtype=np.uint64)

    def __call__(self, shingles: np.ndarray, step: int = 2048) -> np.ndarray:
        low = np.full(len(self.a), 2**64 - 1, np.uint64)
        for at in range(0, len(shingles), step):  # bounded memory for very long texts
            low = np.minimum(low, (self.a * shingles[None, at : at + step] + self.b).min(axis=1))
        return (low >> np.uint64(32)).astype(np.uint32)
