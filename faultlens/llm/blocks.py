"""Helpers of the task-side code: whole texts in pieces of bounded memory, words as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4_000_000  # text handled at once inside a task; a longer single text is a slice of its own


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, cut where the texts of a piece would pass the limit. No text is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and the offsets of the texts in it; null is empty."""
    filled = pc.fill_null(array.cast(pa.large_string()), "")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    held = filled.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the words between gaps (white space, if not said otherwise), and the number of
    words in each text."""
    gap = gaps[data]
    first = ~gap
    last = first.copy()
    at_start = np.zeros(len(data) + 1, bool)
    at_start[offsets] = True
    first[1:] &= gap[:-1] | at_start[1:-1]
    last[:-1] &= gap[1:] | at_start[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of byte ranges in ascending order that don't overlap: a polynomial in the
    bytes, taken from running sums, then mixed with the length. Equal bytes give equal hashes
    everywhere; different ones agree with a chance of about 2^-64."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + piece, side="right")))
        held = data[lo : ends[to - 1]]
        sums = np.zeros(len(held) + 1, np.uint64)
        np.cumsum(_BYTES[held] * _powers(_BASE, len(held)), out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        inverse = _powers(_INVERSE, int(s[-1]) + 1)
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        at = to
    return out


#: Every ASCII character but letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(array: pa.Array, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z lower-cased, of all texts, and the number of words in each text."""
    data, offsets = utf8(array)
    data = _LOWER[data]
    starts, ends, counts = words(data, offsets, gaps)
    return hashes(data, starts, ends), counts


def distinct(values: np.ndarray) -> np.ndarray:
    """Different values in ascending order; for large integer arrays faster than by hashing."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return values[first]
