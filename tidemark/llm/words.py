"""Word splitting and rolling hashes over Arrow text columns, in numpy, for code that runs inside tasks.

Words are maximal runs of characters other than space and the controls 9 to 13, as bytes of UTF-8:
none of the separators is part of a longer UTF-8 sequence, so a byte scan and a character scan agree.
All arrays are flat over the rows of a chunk; ``row`` maps a word to its row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: For plain words: ASCII other than letters and digits separates, ASCII capitals are small letters.
_PLAIN_SPACE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_PLAIN_VALUE = _BYTE_VALUE.copy()
_PLAIN_VALUE[65:91] = _BYTE_VALUE[97:123]
_powers = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            step = np.full(n, b, U)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    data: np.ndarray  # uint8, the bytes of all rows
    offsets: np.ndarray  # of the rows in data, one more than rows
    start: np.ndarray  # of the words in data
    end: np.ndarray
    row: np.ndarray  # of the words
    first: np.ndarray  # of the rows: their first word; one more than rows
    plain: bool = False

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, U)
        power, inverse = _power_tables(len(self.data))
        total = np.zeros(len(self.data) + 1, U)
        np.cumsum((_PLAIN_VALUE if self.plain else _BYTE_VALUE)[self.data] * power, dtype=U, out=total[1:])
        value = (total[self.end] - total[self.start]) * inverse[self.start]
        return mix(value + (self.end - self.start).astype(U))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def split_words(column: pa.Array, plain: bool = False) -> Words:
    data, offsets = text_bytes(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, none, np.zeros(len(offsets), np.int64), plain)
    inside = ~(_PLAIN_SPACE if plain else _SPACE)[data]
    edge = np.zeros(len(data) + 1, bool)  # a row begins here
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(data, offsets, start, end, row, np.searchsorted(row, np.arange(len(offsets))), plain)


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each, or a single row."""
    column = batch.column(text)
    _, offsets = text_bytes(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def shingles(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words inside one row, and the run's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    value = np.zeros(n, U)
    for j in range(k):
        value = value * U(0xD6E8FEB86659FD93) + hashes[j : j + n]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(value[at]), at


def anchors(hashes: np.ndarray, row: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimisers: the smallest of each ``window`` consecutive k-word shingles of a row, leftmost on a tie.

    Returns for each window, which covers k + window - 1 words, its first word and its anchor's first word;
    then the shingle hashes and their first words.
    """
    value, at = shingles(hashes, row, k)
    n = len(value) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, value, at
    best = np.lib.stride_tricks.sliding_window_view(value, window).argmin(1) + np.arange(n)
    whole = row[at[:n]] == row[at[window - 1 :]]
    return at[:n][whole], at[best[whole]], value, at


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The slices data[start:end] one after the other, ``gap`` places left after each; and where each begins."""
    size = end - start + gap
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    index = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
    return (data[np.minimum(index, len(data) - 1)] if len(data) else np.zeros(0, data.dtype)), at


def binary_array(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data, np.uint8).tobytes())])


def context_hash(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of each run of words [low, high)."""
    power, inverse = _power_tables(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * power[: len(hashes)], dtype=U, out=total[1:])
    return mix((total[high] - total[low]) * inverse[low] + (high - low).astype(U))
