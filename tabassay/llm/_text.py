"""Vectorised splitting and hashing of whole Arrow text columns.

A batch of texts is one byte buffer; words, lines and windows are index arrays into it. Hashes
are polynomial prefix sums modulo 2**64 over randomised byte values, finished by a 64-bit mixer,
so that any span costs two lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}

WORD_BREAK = np.zeros(256, bool)
WORD_BREAK[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 16, 2 * len(_powers["up"]))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values))
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans, equal for equal sequences wherever they stand."""
    _, down = powers(len(sums))
    out = (sums[ends] - sums[starts]) * down[starts]
    out += (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(out)


@dataclass
class Units:
    """Words or lines of some texts: data[starts[i]:ends[i]], of text row[i]; text r has units first[r]:first[r + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        values = _BYTE_VALUES[LOWER] if lower else _BYTE_VALUES
        return span_hashes(prefix_sums(values[self.data]), self.starts, self.ends)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most limit bytes, or one longer row."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, rows)
        lo = min(hi, rows)


def words(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Maximal runs of bytes outside space and 0x09-0x0D; none crosses a row."""
    inside = ~WORD_BREAK[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[filled] = False
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets)
    return Units(data, starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def lines(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Parts between line feeds; an empty row has one empty line, as str.split gives it."""
    rows = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    counts = np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1]) + 1
    first = np.zeros(rows + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    heads, tails = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    heads[first[:-1]], tails[first[1:] - 1] = True, True
    starts[heads], starts[~heads] = offsets[:-1], feeds + 1
    ends[tails], ends[~tails] = offsets[1:], feeds
    return Units(data, starts, ends, np.repeat(np.arange(rows), counts), first)


def windows(units: Units, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First unit and hash of every run of size units inside one text."""
    last = units.first[units.row + 1] - size
    starts = np.flatnonzero(np.arange(len(hashes)) <= last)
    return starts, span_hashes(prefix_sums(hashes), starts, starts + size)
