"""Words of whole Arrow text columns, found and hashed column-wise in numpy.

Words are runs of bytes other than space and 0x09-0x0D, which in UTF-8 are whole characters.
Texts are handled in chunks of about ``CHUNK`` bytes (a longer text is one chunk), so the
working arrays of a task stay small.  Hashes are polynomial over the bytes, then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C55          # odd, so it has an inverse modulo 2**64
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, inverse: bool) -> np.ndarray:
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        have = np.full(size, pow(_BASE, -1, 1 << 64) if inverse else _BASE, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 * CHUNK:
            _POWERS[inverse] = have
    return have[:n]


@dataclass
class Words:
    """Words of rows ``lo..hi-1``; ``row`` counts from 0 within the chunk, ``start`` and ``end`` index ``data``."""
    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def first(self) -> np.ndarray:
        """Index of the first word of each row, and the total at the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def hashes(self, start=None, end=None, lower: bool = False, seed: int = 0) -> np.ndarray:
        start, end = self.start if start is None else start, self.end if end is None else end
        return hash_spans(_LOWER[self.data] if lower else self.data, start, end, seed)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), False), out=sums[1:])
    inverse = _powers(len(data) + 1, True)
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null counts as an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def row_chunks(off: np.ndarray, limit: int = CHUNK):
    """Row ranges of about ``limit`` bytes (and at most 16384 rows); a longer text stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 16384)
        yield lo, hi
        lo = hi


def words_of(column, limit: int = CHUNK):
    """``Words`` for consecutive row ranges of an Arrow string column."""
    data, off = text_buffers(column)
    for lo, hi in row_chunks(off, limit):
        base = off[lo]
        part, bounds = data[base:off[hi]], off[lo:hi + 1] - base
        inside = np.zeros(len(part) + 2, dtype=bool)
        inside[1:-1] = _IS_WORD[part]
        begin, stop = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        cut = bounds[1:-1]                                    # a text's end ends its last word
        cut = cut[(cut > 0) & (cut < len(part))]
        both = cut[inside[cut] & inside[cut + 1]]
        begin[both] = True
        stop[both] = True
        start, end = np.flatnonzero(begin), np.flatnonzero(stop)
        yield Words(lo, hi, part, bounds, start, end, np.searchsorted(bounds, start, side="right") - 1)


def lines_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""(row, start, end) of the \n-split lines of the chunk's texts."""
    nl = np.flatnonzero(w.data == 10)
    start = np.sort(np.concatenate([w.bounds[:-1], nl + 1]), kind="stable")
    row_nl = np.searchsorted(w.bounds, nl, side="right") - 1
    row = np.sort(np.concatenate([np.arange(w.rows), row_nl]), kind="stable")
    end = np.empty(len(start), dtype=np.int64)
    end[:-1] = start[1:] - 1
    last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else np.zeros(0, np.int64)
    end[last] = w.bounds[1:]
    return row, start, end


def order_by_row(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order by (row, key)."""
    order = np.argsort(key, kind="stable")
    return order[np.argsort(row[order].astype(np.uint16 if len(row) == 0 or row.max() < 65536 else np.int64), kind="stable")]
