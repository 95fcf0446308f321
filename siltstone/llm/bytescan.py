"""Vectorised scans over UTF-8 bytes: words, hashes of any byte range, and repeats inside a document.

The hash of bytes s..e is sum(T[b[i]] * R**(i - s)) modulo 2**64, finished by a mixing step: with prefix sums, every
range of a batch costs a few array operations and no Python loop.  All functions are pure; numpy only.
"""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15  # odd
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def byte_table(seed: int = 7) -> np.ndarray:
    """256 fixed pseudo-random values, one for each byte."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def lowered(table: np.ndarray) -> np.ndarray:
    """The table that gives A-Z the values of a-z."""
    table = table.copy()
    table[65:91] = table[97:123]
    return table


def class_of(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans that holds for bytes in any of the inclusive ranges."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Bytes of words: all but space and \x09-\x0D.
WORD = ~class_of((0x20, 0x20), (0x09, 0x0D))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Hasher:
    """Hashes of byte ranges; it keeps tables of powers that grow to the longest text seen."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            for name, by in (("power", _MULTIPLIER), ("inverse", _INVERSE)):
                x = np.full(max(n, 1 << 18), by, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``mask``; a run never crosses an offset."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | cut[1:])) + 1
    return starts, ends


def per_doc(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each document the index of its first run, and at last the number of runs."""
    return np.searchsorted(starts, offsets, "left")


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width`` words in a row; with fewer words, of the whole sequence; of no words, none."""
    n = len(words)
    if n == 0:
        return words
    w = min(width, n)
    out = np.zeros(n - w + 1, np.uint64)
    for k in range(w):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : n - w + 1 + k]
    return mix(out + np.uint64(w))
