"""Byte-level text kernels over Arrow columns, for use inside mapInArrow tasks.

A batch is cut into slices of bounded bytes (one longer text is a slice of its own), so numpy temporaries stay small
whatever the batch holds. Texts are never shortened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_rng = np.random.RandomState(20240607)
_BYTE = (_rng.randint(0, 2**32, 256).astype(np.uint64) << np.uint64(32)) | _rng.randint(0, 2**32, 256).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept up to a slice's usual length."""
    have = _powers.get(kind)
    if have is None or len(have) <= n:
        have = np.full(max(n, SLICE_BYTES) + 1, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if n <= 2 * SLICE_BYTES:
            _powers[kind] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes batches on and hands freed memory back at the end, as workers outlive their tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()


def string_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words [^\\x20\\x09-\\x0D]+ of each row with A-Z lowered: start, end, row, 64-bit hash."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    low = data | ((data >= 65) & (data <= 90)).view(np.uint8) << 5
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | fresh[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | fresh[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * _power("up", _BASE, n)[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power("down", _INVERSE, n)[starts])
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows, hashes


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the number of them in each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
