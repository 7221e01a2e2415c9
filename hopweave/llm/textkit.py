"""Vectorised text kernels on Arrow string buffers (numpy only, no Spark).

Texts arrive as Arrow arrays, so their UTF-8 bytes already lie in one buffer.
Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a word's hash is a
polynomial over randomised byte codes modulo 2^64, read off one running sum, so
the cost is a few array passes a byte and no Python object is made per word.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
SLICE_BYTES = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CODE = _BYTE_CODE[_LOWER]
_CODE[_SPACE] = 0
_POSITION = (U64(0xD6E8FEB86659FD93) * (np.arange(1, SHINGLE_WORDS + 1, dtype=U64) * U64(2) + U64(1)))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(base: int, n: int, name: str) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(max(n, SLICE_BYTES + 1), base, dtype=U64)
        p[0] = 1
        _powers[name] = np.multiply.accumulate(p)
        if n > 4 * SLICE_BYTES:  # a giant text: don't keep its table
            return _powers.pop(name)[:n]
    return _powers[name][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text, a longer text alone: bounds the kernels' memory."""
    if not batch.num_rows:
        return
    _, at = buffers(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and where each row's words begin (one entry more than rows)."""
    data, at = buffers(column)
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=U64), np.zeros(len(at), dtype=np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    word = ~space
    begin = word.copy()
    begin[1:] &= space[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= space[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(_CODE[data] * _power(_BASE, n, "up"), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _power(_INVERSE, n, "down")[starts])
    return hashes, np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, at: np.ndarray, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Each row's sorted distinct shingles; with fewer words than `size` the whole sequence is one."""
    if len(hashes) >= size:
        every = hashes[: len(hashes) - size + 1] * _POSITION[0]
        for k in range(1, size):
            every += hashes[k : len(hashes) - size + 1 + k] * _POSITION[k]
        every = mix(every)
    out = []
    for first, last in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if last - first >= size:
            x = np.sort(every[first : last - size + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif last > first:
            out.append(mix((hashes[first:last] * _POSITION[: last - first]).sum(keepdims=True, dtype=U64) + U64(last - first)))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out
