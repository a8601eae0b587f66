"""Vectorised words, hashes and shingles straight from Arrow string buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  All functions work on
whole texts; the scratch memory is bounded by blocks of words, not by the
length of a text.
"""

from __future__ import annotations

import ctypes
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 20
_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15
_Q = np.uint64(0xD6E8FEB86659FD93)
_POW = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        size = 1 << max(10, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            out = np.full(size, np.uint64(_P))
            out[0] = 1
            _POW = np.multiply.accumulate(out)
    return _POW


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


class Words(NamedTuple):
    """Words of a column: byte ranges, 64-bit hashes, and each row's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray  # rows[i]:rows[i + 1] are the words of row i


def words(column: pa.Array, lower: bool) -> Words:
    """Split every row into words; ``lower`` folds A-Z before hashing."""
    data, offs = buffers(column)
    n = len(data)
    ink = ~_WS[data]
    first, last = ink.copy(), ink.copy()
    if n:
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        cut = offs[(offs > 0) & (offs < n)]
        first[cut] = ink[cut]
        last[cut - 1] = ink[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    fold = _LOWER if lower else _SAME
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + _BLOCK, "right")))
            lo, hi = starts[a], ends[b - 1]
            length = ends[a:b] - starts[a:b]
            at = np.flatnonzero(ink[lo:hi])
            values = _TABLE[fold[data[lo:hi][at]]]
            edge = np.zeros(b - a, np.int64)
            np.cumsum(length[:-1], out=edge[1:])
            place = np.arange(len(at)) - np.repeat(edge, length)
            values *= _powers(int(length.max()))[place]
            hashes[a:b] = mix(np.add.reduceat(values, edge) + length.astype(np.uint64) * _Q)
            a = b
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offs))


def strings(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """64-bit hashes of strings of one byte or more, end to end, as ``words`` hashes them."""
    length = np.diff(offs)
    out = np.empty(len(length), np.uint64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + (_BLOCK >> 1), "right")) - 1)
            edge = offs[a:b] - offs[a]
            place = np.arange(offs[b] - offs[a]) - np.repeat(edge, length[a:b])
            values = _TABLE[data[offs[a] : offs[b]]]
            values *= _powers(int(length[a:b].max()))[place]
            out[a:b] = mix(np.add.reduceat(values, edge) + length[a:b].astype(np.uint64) * _Q)
            a = b
    return out


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive entries (fewer than size: none)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for k in range(1, size):
            out *= np.uint64(_P)
            out += hashes[k : k + n]
        return mix(out + np.uint64(size))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one row's words.

    Fewer words than ``size``: the whole sequence is the one shingle; none: empty.
    """
    if len(hashes) == 0:
        return hashes
    return np.unique(windows(hashes, min(size, len(hashes))))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system: a Python worker that waits holds what it keeps, not what it once needed."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21):
    """Cut a batch into row ranges of at most ``most`` text bytes (or one row).

    What the slices needed goes back to the system at the end of the batch.
    """
    col = batch.column(batch.schema.get_field_index(column))
    _, offs = buffers(col)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b
    release()
