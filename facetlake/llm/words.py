"""Words of whole texts as numpy arrays, for tasks that read Arrow batches.

A batch is cut into slices of whole texts of about a megabyte, so the arrays of a task stay small;
one very long text is a slice of its own. Words are runs of bytes; UTF-8 keeps every byte of a
non-ASCII character above 0x7F, so byte classes and character classes agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACES = np.ones(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = False
#: Everything but space and tab to carriage return.
SPACED = _SPACES
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Digits, ASCII letters and everything beyond ASCII.
ALNUM = _ALNUM
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(seed))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0xD1342543DE82EF95
_BYTE = seeded(256, 11)


@dataclass
class Words:
    """Words of some texts: ``first[r]:first[r + 1]`` are those of text ``r``."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with about ``limit`` bytes of whole texts each."""
    data, off = texts(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray = SPACED, lower: bool = False) -> Words:
    """Words of the texts in ``data``; ``kind`` tells which bytes belong to words."""
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    if not len(start):
        return Words(first, start, end, np.zeros(0, np.uint64), row)
    size = end - start
    at = np.flatnonzero(inside)
    place = at - np.repeat(start, size)
    with np.errstate(over="ignore"):
        value = _BYTE[(_LOWER[data] if lower else data)[at]] * powers(_BASE, int(size.max()))[place]
        total = np.add.reduceat(value, np.cumsum(size) - size)
        hashed = mix(total + size.astype(np.uint64) * np.uint64(_STEP))
    return Words(first, start, end, hashed, row)


def grams(hashed: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """Hash of every ``n`` consecutive words; those that cross texts are for the caller to skip."""
    count = len(hashed) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(count, np.uint64)
        for i, factor in enumerate(seeded(n, seed) | np.uint64(1)):
            total += hashed[i : i + count] * factor
        return mix(total)


class Running:
    """Hash of any stretch of words in constant time, the same wherever the stretch stands."""

    def __init__(self, hashed: np.ndarray, seed: int):
        base = int(seeded(1, seed)[0]) | 1
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashed + np.uint64(seed)) * powers(base, len(hashed)), dtype=np.uint64)))
            self.back = powers(pow(base, -1, 1 << 64), len(hashed) + 1)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64) * np.uint64(_STEP))
