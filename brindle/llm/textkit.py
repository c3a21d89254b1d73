"""Vectorised text primitives shared by the text operators.

Everything here works on one Arrow batch at a time: the UTF-8 bytes of all
texts of the batch are one numpy array, and words, shingles and hashes are
computed for the whole batch without a Python loop over characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MIX_A = U64(0xBF58476D1CE4E5B9)
_MIX_B = U64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15
_BASE = U64(0x2545F4914F6CDD1D)
_BASE_INV = U64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))

SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * _MIX_A
    x = x ^ (x >> U64(27))
    x = x * _MIX_B
    return x ^ (x >> U64(31))


def stream64(seed: int, n: int) -> np.ndarray:
    """n pseudo-random words that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix64(U64(seed & (2**64 - 1)) + np.arange(1, n + 1, dtype=U64) * U64(_GOLDEN))


_BYTE_VALUE = stream64(11, 256) | U64(1)
_POWERS: list[np.ndarray] = []
#: Bytes that are hashed at a time.
NEAR = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2**64, for n positions at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, NEAR + 1)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = U64(1)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)]
    return _POWERS[0], _POWERS[1]


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null row is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Gives memory that isn't used any more back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches, with memory given back before the first and after the last."""
    give_back()
    yield from batches
    give_back()


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``limit`` bytes; one longer text is a batch of its own."""
    give_back()  # what the worker's last task has left
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.diff(utf8_of(batch.column(text))[1]))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
    give_back()


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range; equal bytes have equal hashes wherever they stand.

    Of long data a stretch of about NEAR bytes is hashed at a time, if ranges come in
    order of their starts.
    """
    if len(data) <= 2 * NEAR or not (starts[1:] >= starts[:-1]).all():
        return _near(data, starts, ends)
    out, reach, i = np.empty(len(starts), dtype=U64), np.maximum.accumulate(ends), 0
    while i < len(starts):
        low = int(starts[i])
        j = int(np.searchsorted(reach, low + NEAR, side="right"))
        if j > i:
            out[i:j] = _near(data[low : reach[j - 1]], starts[i:j] - low, ends[i:j] - low)
        else:
            j = i + 1
            out[i] = _far(data[low : ends[i]])
        i = j
    return out


def _near(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=U64)
        terms = _BYTE_VALUE[data]
        terms *= up[: len(data)]
        np.cumsum(terms, dtype=U64, out=sums[1:])
        own = (sums[ends] - sums[starts]) * down[starts]
        return mix64(own + (ends - starts).astype(U64) * U64(_GOLDEN))


def _far(data: np.ndarray) -> np.uint64:
    """The hash of one range of any length, a part at a time."""
    total = 0
    for at in range(0, len(data), NEAR):
        part = data[at : at + NEAR]
        with np.errstate(over="ignore"):
            own = int((_BYTE_VALUE[part] * _powers(NEAR)[0][: len(part)]).sum(dtype=U64))
        total += own * pow(int(_BASE), at, 1 << 64)
    with np.errstate(over="ignore"):
        return mix64(np.array([(total + len(data) * _GOLDEN) % (1 << 64)], dtype=U64))[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word and, for n rows, the n + 1 word indexes at which rows begin.

    Words are runs of bytes other than 0x20 and 0x09-0x0D and never cross rows.
    """
    solid = ~SPACE_BYTES[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    start = solid.copy()
    if len(data):
        start[1:] &= ~solid[:-1] | first[1:-1]
    starts = np.flatnonzero(start)
    stop = solid.copy()
    if len(data):
        stop[:-1] &= ~solid[1:] | first[1:-1]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its ``width``-word shingles, A-Z lower-cased.

    A row of fewer words has its whole sequence as one shingle; one without words has none.
    """
    data = _LOWER[data]
    starts, ends, rows = words_of(data, offsets)
    words = hash_ranges(data, starts, ends)
    factor = stream64(29, width) | U64(1)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - width + 1)
        sums = np.zeros(n, dtype=U64)
        for j in range(width):
            sums += words[j : j + n] * factor[j]
        sums = mix64(sums + U64(width))
        out = []
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(sums[a : b - width + 1]))
            elif b > a:
                short = words[a:b] * factor[: b - a]
                out.append(mix64(np.array([short.sum(dtype=U64) + U64(b - a)], dtype=U64)))
            else:
                out.append(np.zeros(0, dtype=U64))
    return out
