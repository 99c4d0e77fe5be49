"""Vectorised word splitting and hashing over Arrow string buffers.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; only A-Z is
lower-cased.  All arithmetic is on uint64 with wrap-around, so a hash depends on
the bytes alone and never on batch limits, workers or the interpreter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LANE = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)  # the first i bytes of eight
_LONG = 512


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (or one row), so temporaries stay small."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def chunks(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) for each slice of a string column."""
    raw, offsets = buffers(column)
    for a, b in slices(offsets, limit):
        yield a, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def spans(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~separators[raw]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~word[:-1]
    starts = np.flatnonzero(word & (before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~word[1:]
    ends = np.flatnonzero(word & (after | cut[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, with A-Z lower-cased: eight bytes at a time go through the finaliser, one after the other.

    Nothing is summed over places, so no structure of the bytes (runs, periods,
    Thue-Morse words) makes hashes meet.  Spans over 512 bytes are digested whole.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    low = np.zeros(len(raw) + 8, np.uint8)
    np.take(LOWER, raw, out=low[: len(raw)])
    eight = np.ndarray(len(raw) + 1, "<u8", low.data, strides=(1,))  # the eight bytes from every place on
    size = ends - starts
    acc = mix((eight[starts] & _LANE[np.minimum(size, 8)]) + size.astype(np.uint64) * U(_BASE))
    at = 8
    more = np.flatnonzero((size > 8) & (size <= _LONG))
    while len(more):
        lane = eight[starts[more] + at] & _LANE[np.minimum(size[more] - at, 8)]
        acc[more] = mix(acc[more] * U(0x9FB21C651E98DF25) + lane)
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size > _LONG):
        acc[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return acc


def chain(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (rows are not looked at)."""
    n = max(0, len(w) - k + 1)
    acc = np.full(n, U(k))
    for j in range(k):
        acc = mix(acc * U(0x9FB21C651E98DF25) + w[j : j + n])
    return acc


def shingle_rows(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every k-word shingle; a row of 1..k-1 words gives one hash of all its words."""
    starts, ends, rows = spans(raw, offsets)
    w = hashes(raw, starts, ends)
    s = chain(w, k)
    ok = rows[: len(s)] == rows[k - 1 :] if len(s) else np.zeros(0, bool)
    out_rows, out = rows[: len(s)][ok], s[ok]
    per_row = np.bincount(rows, minlength=len(offsets) - 1)
    for c in range(1, k):
        few = np.flatnonzero(per_row == c)
        if len(few):
            first = np.searchsorted(rows, few)
            acc = np.full(len(few), U(c))
            for j in range(c):
                acc = mix(acc * U(0x9FB21C651E98DF25) + w[first + j])
            out_rows, out = np.concatenate([out_rows, few]), np.concatenate([out, acc])
    return out_rows, out


def row_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, values): the sorted distinct shingle hashes of every row, back to back."""
    rows, h = shingle_rows(raw, offsets, k)
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    rows, h = rows[keep], h[keep]
    return np.searchsorted(rows, np.arange(len(offsets))), h


def binaries(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary column whose row i holds ``values[bounds[i]:bounds[i + 1]]`` as bytes."""
    size = values.dtype.itemsize
    offs = pa.py_buffer((bounds * size).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offs, pa.py_buffer(np.ascontiguousarray(values).tobytes())])
