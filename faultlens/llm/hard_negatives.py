"""Hard negatives by Four-Russians scoring: exact integer inner products from table look-ups.

A vector's components become integers floor(scale * x). A candidate is held as bit planes in two's
complement: for each bit, one byte for every eight dimensions. For an anchor, each group of eight dimensions
has a table of its 256 subset sums, so one look-up by a plane's byte adds eight components at once;
planes are shifted and added from the sign bit down, which gives the full exact score. Anchors are taken
64 at a time: a look-up then reads a row of 64 sums.

Candidates are dealt into shards by a hash of their row, anchors into blocks; each (shard, block) cell is one
task's work, so neither side is ever held whole, and no label or repeated vector is dealt to one place. The first
pass scores candidates of the anchor's label and keeps its positives, the second scores the others against
the positives' bounds. Shards send the best few of each anchor or (anchor, positive); these meet by it.

Cases: rows with a null id, label or vector, or with a null or non-finite component take no part. A null or
false ``is_anchor`` is no anchor. Every row counts, also those that repeat an id; rows with the anchor's id are no
partners of it. Shorter vectors count as filled with zeros. Ties go to the smaller id. An anchor without a positive,
or a positive without a negative within its bounds gives no row (bounds of a negative score hold none). Scores over 63
bits raise a ValueError. No anchor or candidate, no row; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultlens.operators.sizing import settle

SHARD = 16_384  # candidates of a cell
LEAST_SHARDS = 24  # so that small tables are spread as well
BLOCK = 16_384  # anchors of a cell
TOGETHER = 64  # anchors that share a look-up
TILE = 1_024  # candidates whose sums stay in the cache
NO_SCORE = np.iinfo(np.int64).min


def bit_planes(x: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits, groups of eight dimensions) bytes of integers in two's complement."""
    out = np.empty((len(x), bits, -(-x.shape[1] // 8)), np.uint8)
    for b in range(bits):
        out[:, b] = np.packbits((x >> b) & 1, axis=1, bitorder="little")
    return out


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): the sum of the dimensions whose bit is set, for every byte."""
    groups = -(-anchors.shape[1] // 8)
    held = np.zeros((groups * 8, len(anchors)), kind)
    held[: anchors.shape[1]] = anchors.T
    tables = np.zeros((groups, 256, len(anchors)), kind)
    for j in range(8):
        tables[:, 1 << j : 2 << j] = tables[:, : 1 << j] + held[j::8][:, None]
    return tables


def scores(anchors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(anchors, candidates) exact inner products as int64."""
    n, bits, groups = planes.shape
    most = int(np.abs(anchors).max(initial=0)) * anchors.shape[1] << bits
    kind = np.int32 if most < 1 << 31 else np.int64
    out = np.empty((len(anchors), n), np.int64)
    for a in range(0, len(anchors), TOGETHER):
        tables = subset_sums(anchors[a : a + TOGETHER], kind)
        room = np.empty((TILE, tables.shape[2]), kind)
        for c in range(0, n, TILE):
            tile = planes[c : c + TILE]
            total, looked = np.zeros((len(tile), tables.shape[2]), kind), room[: len(tile)]
            for b in range(bits - 1, -1, -1):
                total <<= 1
                for g in range(groups):
                    np.take(tables[g], tile[:, b, g], axis=0, out=looked, mode="clip")
                    if b == bits - 1:  # the sign bit counts negative
                        total -= looked
                    else:
                        total += looked
            out[a : a + TOGETHER, c : c + TILE] = total.T
    return out


class Cell:
    """A shard's candidates in id order, and a block's anchors."""

    def __init__(self, held: pa.Table, asking: pa.Table, bits: int, dims: int):
        ids, labels = (held.column(c).to_numpy() for c in ("_id", "_label"))
        order = np.argsort(ids, kind="stable")
        groups = -(-dims // 8)
        data = np.frombuffer(b"".join(held.column("_planes").to_pylist()), np.uint8)
        self.ids, self.labels, self.planes = ids[order], labels[order], data.reshape(-1, bits, groups)[order]
        self.rows, self.own, self.asked = (asking.column(c).to_numpy() for c in ("_row", "_id", "_label"))
        x = asking.column("_x").combine_chunks()
        self.x = x.flatten().to_numpy(zero_copy_only=False).reshape(asking.num_rows, dims)

    def scored(self, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of anchors of one label, candidates' ids, scores) for candidates of the same label or of
        the others. Rows with the anchor's own id have no score."""
        groups = [(np.arange(len(self.asked)), slice(None))]
        if same:
            groups = [(np.flatnonzero(self.asked == x), self.labels == x) for x in np.unique(self.asked).tolist()]
        for places, among in groups:
            ids, labels, planes = self.ids[among], self.labels[among], self.planes[among]
            for at in range(0, len(places) if len(ids) else 0, TOGETHER):
                part = places[at : at + TOGETHER]
                found = scores(self.x[part], planes)
                lo, hi = (np.searchsorted(ids, self.own[part], side) for side in ("left", "right"))
                if not same:
                    found[labels == self.asked[part][:, None]] = NO_SCORE
                for i in np.flatnonzero(hi > lo).tolist():
                    found[i, lo[i] : hi[i]] = NO_SCORE
                yield part, ids, found

    def positives(self, k: int) -> Iterator[tuple]:
        for part, ids, found in self.scored(True):
            cut = np.partition(found, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(part), NO_SCORE)
            for i, place in enumerate(part.tolist()):
                left = np.flatnonzero((found[i] >= cut[i]) & (found[i] > NO_SCORE))
                best = left[np.argsort(-found[i, left], kind="stable")[:k]]
                yield np.full(len(best), self.rows[place]), ids[best], found[i, best]

    def negatives(self, lows: list[np.ndarray], highs: list[np.ndarray], k: int) -> Iterator[tuple]:
        for part, ids, found in self.scored(False):
            for i, place in enumerate(part.tolist()):
                low, high = lows[place], highs[place]
                row = found[i]
                left = np.flatnonzero((row >= low.min()) & (row <= high.max()) & (row > NO_SCORE))
                left = left[np.argsort(-row[left], kind="stable")]
                falling = -row[left]
                first = np.searchsorted(falling, -high, "left")
                end = np.minimum(first + k, np.searchsorted(falling, -low, "right"))
                for p in np.flatnonzero(end > first).tolist():
                    best = left[first[p] : end[p]]
                    yield np.full(len(best), self.rows[place]), np.full(len(best), p), ids[best], row[best]


def _table(parts: Iterator[tuple], names: list[str]) -> pa.Table:
    held = list(zip(*parts)) or [()] * len(names)
    return pa.table({n: pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for n, c in zip(names, held)})


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of an anchor's best
    ``positives`` rows of its own label the ``negatives`` best rows of other labels whose score is between ``low``
    and ``high`` percent of the positive's."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    sound = vectors.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(whole)
    rows = sound.select(
        F.col(key).cast("long").alias("_id"),
        F.col(label).cast("long").alias("_label"),
        F.col(vector).cast("array<double>").alias("_v"),
        F.coalesce(is_anchor, F.lit(False)).alias("_asks"),
    )
    size = F.array_max(F.transform("_v", lambda x: F.abs(F.floor(x * scale).cast("double"))))
    n, asking, dims, most = rows.agg(F.count("*"), F.count_if("_asks"), F.max(F.size("_v")), F.max(size)).first()
    dims, most = max(1, dims or 0), int(most or 0)
    bits = most.bit_length() + 1
    if dims * most << bits >= 1 << 63:
        raise ValueError("scores would not fit 63 bits")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_v")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            x = np.zeros((len(sizes), dims), np.int64)
            x[np.arange(dims) < sizes[:, None]] = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
            asks = batch.column("_asks").to_numpy(zero_copy_only=False).astype(bool)
            held = pa.array([p.tobytes() for p in bit_planes(x, bits)], pa.binary())
            ends = pa.array(np.concatenate(([0], np.cumsum(np.where(asks, dims, 0)))).astype(np.int32))
            own = pa.ListArray.from_arrays(ends, pa.array(x[asks].reshape(-1)))
            columns = [batch.column("_row"), batch.column("_id"), batch.column("_label"), pa.array(asks), own, held]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "_id", "_label", "_asks", "_x", "_planes"])

    # Written, so that a row keeps its number.
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    packed = settle(numbered.mapInArrow(pack, "_row long, _id long, _label long, _asks boolean, _x array<long>, _planes binary"))
    shards, blocks = max(LEAST_SHARDS, -(-n // shard)), max(1, -(-asking // block))
    deal = lambda seed, of: F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    candidates = packed.select("_id", "_label", "_planes", deal(1, shards).alias("_s"), every(blocks).alias("_b"))
    held = candidates.groupBy("_s", "_b")
    anchors = packed.filter("_asks").select("_row", "_id", "_label", "_x")

    def cells(asked: DataFrame):
        return held.cogroup(asked.select("*", deal(2, blocks).alias("_b"), every(shards).alias("_s")).groupBy("_s", "_b"))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        return _table(Cell(left, right, bits, dims).positives(positives), ["_row", "pos_id", "score"])

    found = cells(anchors).applyInArrow(find, "_row long, pos_id long, score long")
    best = Window.partitionBy("_row").orderBy(F.desc("score"), "pos_id")
    few = found.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= positives)
    listed = few.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_k", "pos_id", "score"))).alias("_pos"))
    asked = settle(anchors.join(listed, "_row"))

    def bounded(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = right.column("_scores").to_pylist()
        # low * p <= 100 * n <= high * p in whole numbers
        lows = [np.array([-(-low * p // 100) for p in ps]) for ps in lists]
        highs = [np.array([high * p // 100 for p in ps]) for ps in lists]
        return _table(Cell(left, right, bits, dims).negatives(lows, highs, negatives), ["_row", "_p", "negative_id", "negative_score"])

    scored = asked.select("_row", "_id", "_label", "_x", F.col("_pos.score").alias("_scores"))
    near = cells(scored).applyInArrow(bounded, "_row long, _p long, negative_id long, negative_score long")
    order = Window.partitionBy("_row", "_p").orderBy(F.desc("negative_score"), "negative_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    names = asked.select("_row", F.col("_id").alias("anchor_id"), F.posexplode("_pos").alias("_at", "_one"))
    names = names.select("_row", "anchor_id", F.col("_at").cast("long").alias("_p"), F.col("_one.pos_id").alias("positive_id"), F.col("_one.score").alias("positive_score"))
    return ranked.join(names, ["_row", "_p"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
