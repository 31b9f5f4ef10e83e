"""Vectorised text arithmetic on Arrow string buffers.

Everything here works on one contiguous UTF-8 buffer plus document offsets
(the memory layout of an Arrow string column), so a batch of documents is
tokenised and hashed by a fixed number of numpy passes and no per-word Python.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; no word
crosses a document boundary.  Null texts have no bytes and so no words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = (1 << 20) - 64

_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a batch into runs of whole rows with about ``limit`` text bytes each."""
    lengths = byte_lengths(batch.column(column))
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def byte_lengths(array: pa.Array) -> np.ndarray:
    buffer_offsets = offsets_of(array)
    return np.diff(buffer_offsets)


def offsets_of(array: pa.Array) -> np.ndarray:
    """Absolute byte offsets of a string or binary array (null rows span zero bytes)."""
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        kind = np.int32
    raw = np.frombuffer(array.buffers()[1], dtype=kind) if array.buffers()[1] is not None else np.zeros(1, kind)
    offsets = raw[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
        return offsets_of(array)
    if len(offsets) == 0:
        return np.zeros(1, np.int64)
    return offsets


def buffer_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows end to end, and the rows' offsets in them from 0."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    offsets = offsets_of(array)
    data = array.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(maxsize=8)
def _powers(lane: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[lane]
    inverse = pow(base, -1, 1 << 64)
    out = []
    for factor in (base, inverse):
        table = np.ones(size, dtype=np.uint64)
        filled = 1
        while filled < size:
            step = np.uint64(pow(factor, filled, 1 << 64))
            n = min(filled, size - filled)
            table[filled : filled + n] = table[:n] * step
            filled += n
        out.append(table)
    return out[0], out[1]


def powers(lane: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the lane's odd base and of its inverse modulo 2**64, at least ``size`` of each."""
    rounded = 1 << max(16, int(size).bit_length())
    return _powers(lane, rounded)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words:
    """Word positions of a batch: ``start`` and ``end`` byte offsets, ``doc`` row numbers, ``first`` word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = ~space[data]
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = solid[:-1]
            after[-1] = False
            after[:-1] = solid[1:]
            inner = offsets[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            before[inner] = False
            after[inner - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit polynomial hash of each word's bytes, finalised with its length."""
        return span_hashes(self.data, self.start, self.end, lane)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of each span of bytes, finalised with its length."""
    n = len(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(lane, n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rolling(h: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``width`` consecutive items (also those that cross documents)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(_BASES[1 - lane])
    out = h[:n].copy()
    for j in range(1, width):
        out *= base
        out += h[j : j + n]
    return mix(out)


def sliding_min(values: np.ndarray, window: int) -> np.ndarray:
    """Minima of all windows of ``window`` consecutive values, by doubling."""
    if len(values) < window:
        return values[:0]
    out, have = values, 1
    while have < window:
        step = min(have, window - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def covered(marks: np.ndarray, width: int, size: int) -> np.ndarray:
    """Mask of the ``size`` items inside any window of ``width`` that starts at a marked position."""
    edge = np.zeros(size + 1, dtype=np.int32)
    at = np.flatnonzero(marks)
    edge[at] += 1
    np.subtract.at(edge, np.minimum(at + width, size), 1)
    return np.cumsum(edge[:size]) > 0
