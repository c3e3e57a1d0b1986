"""Exact top-k inner products by no-random-access aggregation.

Vectors are dealt into shards by a hash of their id, queries into blocks; each (shard, block) cell is
one task's work, so neither side is ever held whole. A shard keeps one sorted list for each dimension.
A cell reads all lists step by step from the end that a query's sign asks for, for all its queries at
once. What has been read gives every vector a lower score bound (unread components at the far end
of their list) and an upper one (unread components at the list's present value). A query stops when the
upper bounds of all vectors outside its k best lower bounds are below them; only those that are left get
their final score. The k best of every shard then meet by query.

Cases: rows with a null id or vector, or with a null or non-finite component take no part. Of rows that
repeat an id, the one with the smallest vector counts. Shorter vectors count as filled with zeros.
Ties go to the smaller id. With fewer than k candidates all are returned; no query or candidate, no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultlens.operators.sizing import settle

SHARD = 4_096  # vectors with common sorted lists
LEAST_SHARDS = 24  # so that small tables are spread as well
BLOCK = 4_096  # queries that read a shard's lists together
STEP = 1.6  # growth of the depth from one look at the bounds to the next


def matrix(vectors: pa.Array, scale: int) -> np.ndarray:
    """Quantised vectors as rows, shorter ones filled with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


class Shard:
    """Sorted lists of a set of vectors: for each dimension their places in ascending order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        n, d = self.x.shape
        self.sorted = np.sort(self.x, axis=0)
        self.place = np.empty((n, d), np.int64)
        np.put_along_axis(self.place, np.argsort(self.x, axis=0, kind="stable"), np.arange(n)[:, None], axis=0)

    def search(self, own: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of the k best vectors other than the query itself."""
        n = len(self.ids)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        # Far ends of the lists: what an unread component adds at least.
        least = up * self.sorted[0] + down * self.sorted[-1]
        same = np.searchsorted(self.ids, own)
        same = np.where((same < n) & (self.ids[np.minimum(same, n - 1)] == own), same, n)
        active, depth = np.arange(len(q)), max(1, n // 16)
        while len(active):
            depth = min(n, depth)
            high, low = self.place >= n - depth, self.place < depth  # read from above, from below
            # up and down never overlap in a dimension, so reading sums split into two products.
            a, b = up[active], down[active]
            read = a @ np.where(high, self.x, 0).T + b @ np.where(low, self.x, 0).T
            now = a * self.sorted[n - depth] + b * self.sorted[depth - 1]
            rising = a > 0
            lows, tops = np.where(rising, 0, least[active]), np.where(rising, 0, now)
            lower = read + least[active].sum(1)[:, None] - (least[active] - lows) @ high.T - lows @ low.T
            upper = read + now.sum(1)[:, None] - (now - tops) @ high.T - tops @ low.T
            own_place = same[active]
            has = np.flatnonzero(own_place < n)
            lower[has, own_place[has]] = upper[has, own_place[has]] = -np.inf
            if depth == n or n <= k:
                kth, done = np.full(len(active), -np.inf), np.ones(len(active), bool)
                if n > k:
                    kth = np.partition(lower, n - k, axis=1)[:, n - k]
            else:
                kth = np.partition(lower, n - k, axis=1)[:, n - k]
                # Done when no more vectors than the k best may still reach the k-th lower bound.
                done = (upper >= kth[:, None]).sum(1) <= k
            for i in np.flatnonzero(done).tolist():
                left = np.flatnonzero((upper[i] >= kth[i]) & (upper[i] > -np.inf))
                score = self.x[left] @ q[active[i]]
                best = np.lexsort((self.ids[left], -score))[:k]
                yield int(active[i]), self.ids[left][best], score[best]
            active = active[~done]
            depth = int(depth * STEP) + 1


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, block: int = BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query's vector
    with all others. Scores must stay below 2^53."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    sound = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(whole)
    rows = sound.select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q"))
    one = settle(rows.groupBy("_id").agg(F.min("_v").alias("_v"), F.max("_q").alias("_q")))
    n, queries = one.agg(F.count("*"), F.count(F.when(F.col("_q"), 1))).first()
    shards, blocks = max(LEAST_SHARDS, -(-n // shard)), max(1, -(-queries // block))
    deal = lambda seed, of: F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    candidates = one.select("_id", "_v", deal(1, shards).alias("_s"), every(blocks).alias("_b"))
    asking = one.filter("_q").select("_id", "_v", deal(2, blocks).alias("_b"), every(shards).alias("_s"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            x, q = (matrix(t.column("_v").combine_chunks(), scale) for t in (left, right))
            d = max(x.shape[1], q.shape[1])
            x, q = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (x, q))
            own = right.column("_id").to_numpy()
            held = Shard(left.column("_id").to_numpy(), x)
            for i, ids, score in held.search(own, q, k):
                out[0].append(np.full(len(ids), own[i]))
                out[1].append(ids)
                out[2].append(score.astype(np.int64))
        columns = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out]
        return pa.Table.from_arrays(columns, ["query_id", "vec_id", "score"])

    found = candidates.groupBy("_s", "_b").cogroup(asking.groupBy("_s", "_b")).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
