"""Vectorised kernels over the UTF-8 bytes of Arrow string columns.

Words are maximal runs of bytes outside ``0x20`` and ``0x09-0x0D``.  UTF-8 never
uses those bytes inside a longer character, so splitting bytes equals splitting
code points.  Nulls count as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_CHUNK_BYTES = 4 << 20


def powers(n: int) -> np.ndarray:
    """``_ODD ** i`` modulo 2**64 for i below n."""
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    out[1:] = _ODD
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = _CHUNK_BYTES):
    """Row ranges of about ``most`` bytes each, at least one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


class Words:
    """Word bounds and word hashes of a block of rows.

    ``start``/``end`` are byte positions, ``row_words[i]:row_words[i+1]`` are the
    words of row i and ``hash`` holds a 64-bit hash of each word's bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True):
        inside = ~_SPACE[data]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | first[1:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | first[1:-1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.row_words = np.searchsorted(self.start, offsets)
        self.hash = np.empty(0, np.uint64)
        if hashed and len(self.start):
            self.hash = self._hash(_LOWER[data] if lower else data, inside)

    def _hash(self, data: np.ndarray, inside: np.ndarray) -> np.ndarray:
        length = self.end - self.start
        at = np.arange(int(length.sum()), dtype=np.int64)
        begin = np.concatenate(([0], np.cumsum(length)[:-1]))
        at -= np.repeat(begin, length)
        table = powers(int(length.max()))
        with np.errstate(over="ignore"):
            codes = _BYTE_CODE[data[inside]] * table[at]
            return mix64(np.add.reduceat(codes, begin) + length.astype(np.uint64))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of one text; a
    shorter text has one shingle, its whole word sequence; no word gives none."""
    n = len(words)
    if not n:
        return words
    take = min(size, n)
    with np.errstate(over="ignore"):
        out = np.full(n - take + 1, np.uint64(take), dtype=np.uint64)
        for i in range(take):
            out = mix64(out * _ODD + words[i : n - take + 1 + i])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]
