"""Words, word hashes and word shingles of many texts at once, as NumPy arrays.

A word is a run of ASCII digits, ASCII letters (lower-cased) and characters
outside ASCII; on UTF-8 bytes that is a class of bytes, so no text is decoded.
A word's hash is a polynomial over random 64-bit values of its bytes, so that
all words of a slice are hashed by one multiplication and one segmented sum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RNG = np.random.default_rng(20240611)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_VALUE[~_IS_WORD] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SHINGLE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a slice of texts: text ``i`` has words ``first[i]`` up to ``first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(buf: np.ndarray, at: np.ndarray, want_end: bool = False) -> Words:
    """Find and hash all words of the texts that begin at ``at`` in ``buf``."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(at), np.int64))
    inside = _IS_WORD[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < n]
    begins[edge] = inside[edge]
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, at)
    if len(start) == 0:
        return Words(start, start, np.zeros(0, np.uint64), first)
    up, down = _power(n)
    value = _VALUE[buf]
    value *= up[:n]
    h = mix(np.add.reduceat(value, start) * down[start])
    end = start
    if want_end:
        gap = np.add.reduceat(inside, start, dtype=np.int64)
        end = start + gap
    return Words(start, end, h, first)


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words within a text, and where each text's begin.

    A text of fewer words, but not none, is one shingle of all its words.
    """
    count = w.count
    n = len(w.hash)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(w.first), np.int64)
    padded = np.concatenate([w.hash, np.zeros(size, np.uint64)])
    total = np.zeros(n, np.uint64)
    left = np.repeat(w.first[1:], count) - np.arange(n)  # words from here to the text's end
    for k in range(size):
        part = padded[k : k + n] * _SHINGLE[k]
        if k:
            part[left <= k] = 0
        total += part
    per = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    keep = (left >= size) | ((np.repeat(count, count) < size) & (left == np.repeat(count, count)))
    return mix(total[keep]), np.concatenate([[0], np.cumsum(per)])


def sequence_hash(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence; equal for equal sequences."""
    count = w.count
    out = []
    place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], count)
    for seed in (0x51ED270B, 0x2545F491):
        salted = mix(w.hash + np.uint64(seed) * np.uint64(2654435761))
        v = mix(salted + mix(place.astype(np.uint64) + np.uint64(seed)))
        total = np.zeros(len(count), np.uint64)
        if some := np.flatnonzero(count).tolist():
            total[some] = np.add.reduceat(v, w.first[:-1][some])
        out.append(mix(total + count.astype(np.uint64)))
    return out[0], out[1]
