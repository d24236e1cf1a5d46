"""Words of a batch of texts and their 64-bit hashes, as numpy arrays over the texts' bytes.

Words are the runs of bytes other than ASCII white space. The hash of a word is a polynomial in a random
odd number over random values of its bytes, taken from prefix sums over the batch and mixed at the end; it does not
depend on where the word stands.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

BASE = 0x9E6C63D0876A9A35 | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * M1
    h = h ^ (h >> np.uint64(29))
    h = h * M2
    return h ^ (h >> np.uint64(32))


BLOCK = 1 << 20  # bytes hashed at a time


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, more than 2^bits of each."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.ones(1, np.uint64)
        while len(p) <= 1 << bits:
            p = np.concatenate((p, p * np.uint64(pow(base, len(p), 1 << 64))))
        out.append(p)
    return out[0], out[1]


@dataclass(frozen=True)
class Words:
    """Words of a batch in order: the row of each, where it starts and ends, and its hash."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def words(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> Words:
    """Words of the rows raw[start:end], which lie one after the other; A-Z count as a-z if ``lower``."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, np.uint64))
    parts, at = [], 0
    while at < len(raw):
        to = _boundary(raw, start, at + BLOCK)
        parts.append(_block(raw[at:to], start[(start >= at) & (start < to)] - at, lower, at))
        at = to
    first, stop, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(np.searchsorted(end, first, side="right"), first, stop, h)


def _boundary(raw: np.ndarray, start: np.ndarray, at: int) -> int:
    """The first place from ``at`` on where no word goes on: white space, a row's start, or the end."""
    if at >= len(raw):
        return len(raw)
    k = int(np.searchsorted(start, at))
    stop = int(start[k]) if k < len(start) else len(raw)
    while at < stop:
        blank = np.flatnonzero(SPACE[raw[at:min(stop, at + BLOCK)]])
        if len(blank):
            return at + int(blank[0])
        at += BLOCK
    return stop


def _block(raw: np.ndarray, start: np.ndarray, lower: bool, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    ink = ~SPACE[raw]
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    begins[start] = ink[start]  # a row's first byte begins a word, and the one before it ends one
    before = start[start > 0] - 1
    ends[before] = ink[before]
    first, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    powers, inverse = _powers(max(20, n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(VALUES[LOWER[raw] if lower else raw] * powers[:n], out=sums[1:])
    return first + offset, stop + offset, mix((sums[stop] - sums[first]) * inverse[first] + (stop - first).astype(np.uint64))
