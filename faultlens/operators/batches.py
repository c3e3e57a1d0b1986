"""Helpers of the task-side code: Arrow batches in pieces of bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_VALUES = 1 << 19  # list values handled at once inside a task; a longer single list is a piece of its own


def list_sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def list_slices(lists: pa.Array, limit: int = SLICE_VALUES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lists hold up to ``limit`` values together. No list is cut."""
    ends = np.cumsum(list_sizes(lists))
    start = 0
    while start < len(lists):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


def distinct(values: np.ndarray) -> np.ndarray:
    """Different values in ascending order; for large integer arrays faster than by hashing."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return values[first]
