"""Ranking and ranking metrics inside one row: rows x labels is never shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens.functions.binding import bind


def rank_labels(scores: Column) -> Column:
    """Label indices, best score first; equal scores keep the lower index first."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("cost"), i.alias("label_idx")))
    return F.transform(F.array_sort(pairs), lambda p: p["label_idx"])


def top_k(ranked: Column, k: int) -> Column:
    return F.slice(ranked, 1, k)


def true_labels(y: Column) -> Column:
    """Indices of the ones in a multi-hot row."""
    flagged = F.transform(y, lambda v, i: F.when(v == 1, i))
    return F.filter(flagged, lambda i: i.isNotNull())


def ranks_in_order(ranked: Column, truth: Column) -> Column:
    """1-based ranks at which true labels stand, ascending; labels not ranked are left out."""

    def ranks(row: Column) -> Column:
        return F.transform(row["t"], lambda i: F.array_position(row["r"], i).cast("int"))

    found = bind(F.struct(ranked.alias("r"), truth.alias("t")), ranks)
    return F.array_sort(F.filter(found, lambda r: r > 0))


def ranks_from_scores(scores: Column, y: Column) -> Column:
    """Same as ranking first, without the sort: count what stands before each true label."""

    def ranks(row: Column) -> Column:
        def standing(own: Column, i: Column) -> Column:
            before = F.filter(row["s"], lambda s, j: (s > own) | ((s == own) & (j < i)))
            return F.size(before) + 1

        return F.transform(row["y"], lambda v, i: F.when(v == 1, standing(F.get(row["s"], i), i)))

    found = bind(F.struct(scores.alias("s"), y.alias("y")), ranks)
    return F.array_sort(F.filter(found, lambda r: r.isNotNull()))


def hits_at(ranks: Column, k: int) -> Column:
    return F.size(F.filter(ranks, lambda r: r <= k))


def row_recall(ranks: Column, n_true: Column, k: int) -> Column:
    """Null when the row has no true label, so that a mean skips it."""
    return F.when(n_true > 0, hits_at(ranks, k) / n_true)


def row_precision(ranks: Column, k: int) -> Column:
    return F.lit(0.0) if k == 0 else hits_at(ranks, k) / F.lit(k)


def row_hit(ranks: Column, k: int) -> Column:
    return (hits_at(ranks, k) > 0).cast("double")


def row_reciprocal_rank(ranks: Column, n_true: Column) -> Column:
    return F.when(n_true > 0, F.coalesce(F.lit(1.0) / F.array_min(ranks), F.lit(0.0)))


def row_average_precision(ranks: Column, n_true: Column) -> Column:
    """The j-th hit stands at ranks[j], so precision there is j / ranks[j]."""
    terms = F.transform(ranks, lambda r, j: (j + 1) / r)
    return F.when(n_true > 0, F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / n_true)
