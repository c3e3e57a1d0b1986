"""Questions from blocks of rows about keys of the whole corpus, and the answers back to the blocks.

A block holds each of its different keys (hashes) once, however often its rows do, so a key that
fills a third of the corpus costs one entry for each block. Keys are cut into ranges of equal width; a range's
entries of all blocks meet in one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Key ranges for each shuffle partition, so that ranges dealt by a hash fill partitions evenly.
SPREAD = 4


def ranges(spark: SparkSession, spread: int = SPREAD) -> int:
    return spread * int(spark.conf.get("spark.sql.shuffle.partitions"))


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the ranges begin and end in ascending unsigned 64-bit keys."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


def planes(values: np.ndarray) -> bytes:
    """Bytes of the values, place by place, so that equal high bytes lie together and pack well."""
    if not len(values):
        return b""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(kind).reshape(n)


def bundle(*columns: np.ndarray) -> bytes:
    """Columns of one length as one packed value: the length, then the columns' planes."""
    n = len(columns[0])
    raw = b"".join(planes(c) for c in columns)
    return n.to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if n else b"")


def unbundle(data: bytes, *kinds: type) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 0, []
    if not n:
        return [np.empty(0, k) for k in kinds]
    sizes = [n * np.dtype(k).itemsize for k in kinds]
    raw = pa.decompress(data[8:], sum(sizes), "zstd", asbytes=True)
    for kind, size in zip(kinds, sizes):
        out.append(from_planes(raw[at : at + size], n, kind))
        at += size
    return out
