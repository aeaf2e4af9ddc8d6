"""Vectorised hashing of words and byte windows over Arrow string batches.

All functions work on UTF-8 bytes. A prefix-sum of ``T[byte] * B**i`` modulo 2**64
gives the hash of any byte range in constant time, so a batch is hashed with a
handful of numpy passes and no loop over characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_RNG = np.random.default_rng(20240607)
#: A random word for each byte; _LOWER folds A-Z onto a-z.
_TABLE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MIX = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLICE = 1 << 20
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > 4 * SLICE:  # kept for usual sizes only, so memory stays bounded
            return out[0], out[1]
        _powers = (out[0], out[1])
    return _powers[0][:n], _powers[1][:n]


def finalise(h: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit words."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse powers): the hash of data[a:b] is (sums[b] - sums[a]) * inverse[a]."""
    p, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * p[:-1], out=sums[1:])
    return sums, inverse


def utf8_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of consecutive rows, up to about ``limit`` bytes at once; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(end, n), whole[offsets[first] : offsets[min(end, n)]], offsets[first : min(end, n) + 1] - offsets[first]
        first = min(end, n)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end of every word, index of each row's first word), words being runs of bytes that are no separator."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = separator[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = gap[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = gap[1:]
    after[inner - 1] = True
    starts = np.flatnonzero(before & ~gap)
    ends = np.flatnonzero(after & ~gap) + 1
    sums, inverse = prefix_sums(data, _LOWER if lower else _TABLE)
    h = finalise((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MIX[15])
    return h, starts, ends, np.searchsorted(starts, offsets)


def shingles(h: np.ndarray, rows: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; all words as one where they are fewer."""
    n = len(h)
    joined = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k if n >= k else 0):
        joined += h[i : n - k + 1 + i] * _MIX[i]
    joined = finalise(joined)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= k:
            x = joined[a : b - k + 1]
            x = np.sort(x)
            yield x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x
        elif b > a:
            yield finalise((h[a:b] * _MIX[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
