"""Words and shingles of Arrow text columns as numpy arrays, without a Python object per word.

Spark hands a task Arrow batches; these helpers view a batch's UTF-8 buffer and describe its words
by byte positions and 64-bit hashes.  A word is a run of bytes other than space and \\t \\n \\v \\f \\r.
Rows are taken in runs of about ``CHUNK`` bytes, so the temporary arrays stay small however many rows
a batch has; a single longer text is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1_000_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


_BYTE = seeds(256, 11)
_RATIO = int(seeds(1, 12)[0]) | 1
_PLACE = seeds(64, 13) | np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``ratio**i`` and its inverse modulo 2**64 for ``i < n``; grown on demand, kept per worker."""
    if not _powers or len(_powers[0]) < n:
        tables = []
        for base in (_RATIO, pow(_RATIO, -1, 1 << 64)):
            steps = np.full(max(n, CHUNK) + 1, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.string()) if pa.types.is_null(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows [lo, hi) of about ``size`` bytes, at least one row each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Words:
    """The words of some rows: byte positions, the row of each, and where each row's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the rows given by ``offsets``; a row border also ends a word."""
    n, rows = len(data), len(offsets) - 1
    inside = ~SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    heads, tails = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
    before[heads], after[tails] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, np.repeat(np.arange(rows), np.diff(first)), first)


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash per word, equal for equal bytes wherever they stand."""
    up, down = powers(len(w.data) + 1)
    total = np.zeros(len(w.data) + 1, np.uint64)
    np.cumsum(_BYTE[w.data] * up[: len(w.data)], out=total[1:])
    return mix64((total[w.ends] - total[w.starts]) * down[w.starts])


def shingles(w: Words, word_hash: np.ndarray, length: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row, and where each row's begin.

    A row with fewer than ``length`` words, but at least one, has its whole sequence as one shingle.
    """
    rows, count = len(w.first) - 1, w.counts
    made = np.where(count >= length, count - length + 1, np.minimum(count, 1))
    first = np.zeros(rows + 1, np.int64)
    np.cumsum(made, out=first[1:])
    out = np.zeros(first[-1], np.uint64)
    if len(out):
        at = np.repeat(w.first[:-1] - first[:-1], made) + np.arange(len(out))
        size = np.repeat(np.minimum(count, length), made)
        for j in range(length):
            here = size > j
            out[here] += mix64(word_hash[at[here] + j] + _PLACE[j]) * _PLACE[j + 8]
        out = mix64(out)
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            if hi - lo > 1:
                out[lo:hi].sort()
        keep = np.ones(len(out), bool)
        keep[1:] = out[1:] != out[:-1]
        keep[first[:-1][made > 0]] = True
        kept = np.zeros(len(out) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        out, first = out[keep], kept[first]
    return out, first


def minima(values: np.ndarray, first: np.ndarray, multipliers: np.ndarray, addends: np.ndarray) -> np.ndarray:
    """Per row and permutation, the least 32-bit value of ``(a * x + b) mod 2**64``'s high half.

    Rows without values get the largest value in every place.
    """
    rows = len(first) - 1
    out = np.full((len(multipliers), rows), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        heads = first[full]
        buffer = np.empty_like(values)
        for k, (a, b) in enumerate(zip(multipliers, addends, strict=True)):
            np.multiply(values, a, out=buffer)
            np.add(buffer, b, out=buffer)
            out[k, full] = np.minimum.reduceat(buffer, heads) >> np.uint64(32)
    return out.T.copy()


def permutations(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of ``n`` members of a universal family."""
    return seeds(n, salt) | np.uint64(1), seeds(n, salt + 1)
