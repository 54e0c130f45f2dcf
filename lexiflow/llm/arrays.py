"""Numpy helpers on Arrow text columns: words as byte ranges, and hashes of
all words and word windows of a batch without a Python loop.

A word is a run of bytes other than ``\\x20`` and ``\\x09-\\x0D``; since these
are ASCII, working on UTF-8 bytes equals working on characters."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd multipliers of the polynomial hashes (modulo 2**64).
BYTE_BASE = 0x9E3779B97F4A7C15
WINDOW_BASE = 0xD6E8FEB86659FD93

_powers: dict[int, np.ndarray] = {}


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, max_bytes: int):
    """Row ranges of at most ``max_bytes`` (one longer row stands alone)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each row (n + 1)."""
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if n <= 1 << 23:
            _powers[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, from prefix sums of a byte polynomial."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(BYTE_BASE, len(data)), out=sums[1:])
    inverse = _power_table(pow(BYTE_BASE, -1, 1 << 64), len(data))
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + mix((ends - starts).astype(np.uint64)))


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of ``size`` words within one row.

    Returns the index of each window's first word and its hash."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    count = n - size + 1
    rolled = np.zeros(count, np.uint64)
    base = np.uint64(WINDOW_BASE)
    for k in range(size):
        rolled *= base
        rolled += hashes[k:k + count]
    row_end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(count) + size <= row_end[:count])
    return at, mix(rolled[at])
