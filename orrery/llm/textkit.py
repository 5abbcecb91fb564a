"""Vectorised words and hashes over Arrow text columns.

A chunk of rows is laid out as one byte buffer, a space after every row, so
that no word crosses rows; words, word hashes and word n-gram hashes are then
whole-buffer numpy operations.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once, so that a task's memory doesn't follow its batch.
CHUNK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_BYTE_CODE = mix((np.arange(1, 257, dtype=np.uint64)) * _ODD)


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Letters (after ASCII folding), digits and everything outside ASCII.
ALNUM = _byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but ASCII white space.
SOLID = ~_byte_set((0x20, 0x20), (0x09, 0x0D))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 2 * CHUNK_BYTES if known is None else 2 * len(known))
        known = np.full(size, np.uint64(base))
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _powers[base] = known
    return known[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the n + 1 offsets of the rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """Words of a chunk of rows: byte spans in ``data``, hashes, and the rows' word ranges."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, members: np.ndarray, fold: bool):
        rows = len(offsets) - 1
        starts_of_rows = offsets - offsets[0]
        data = np.full(len(body) + rows, 0x20, np.uint8)
        keep = np.ones(len(data), bool)
        keep[starts_of_rows[1:] + np.arange(rows)] = False
        data[keep] = _FOLD[body] if fold else body
        inside = members[data].view(np.int8)
        edge = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
        self.data = data
        self._sums: np.ndarray | None = None
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.row_start = starts_of_rows + np.arange(rows + 1)
        self.first = np.searchsorted(self.start, self.row_start)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(rows), self.counts)

    def hashes(self) -> np.ndarray:
        return self.hashes_of(self.start, self.end)

    def hashes_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans, as of a word of the same bytes."""
        n = len(self.data)
        if self._sums is None:
            self._sums = np.empty(n + 1, np.uint64)
            self._sums[0] = 0
            np.cumsum(_BYTE_CODE[self.data] * _power_table(_BASE, n), out=self._sums[1:])
        width = (end - start).astype(np.uint64)
        return mix((self._sums[end] - self._sums[start]) * _power_table(_BASE_INVERSE, n + 1)[start] + width * _ODD)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def phrase(self, i: int, n: int) -> bytes:
        return b" ".join(self.word(j) for j in range(i, i + n))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; positions may cross rows, so mask by row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out *= np.uint64(_BASE)
        out += hashes[j : j + m]
    return mix(out + np.uint64(n))


def inside_row(words: Words, n: int) -> np.ndarray:
    """For each position that grams() has: do its n words belong to one row?"""
    m = len(words.row) - n + 1
    return words.row[:m] == words.row[n - 1 :] if m > 0 else np.zeros(0, bool)


def text_chunks(batches: Iterator[pa.RecordBatch], text: str, members: np.ndarray, fold: bool) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of the batches, each with the words of its ``text`` column."""
    for batch in batches:
        body, offsets = text_bytes(batch.column(text))
        for lo, hi in row_chunks(offsets):
            yield batch.slice(lo, hi - lo), Words(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], members, fold)
