"""Score links, thresholds and the focal loss as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def sigmoid_scores(logits: Column) -> Column:
    return F.transform(logits, sigmoid)


def threshold(scores: Column, cut: float = 0.5) -> Column:
    return F.transform(scores, lambda s: (s >= F.lit(cut)).cast("int"))


def cross_entropy(logit: Column, target: Column) -> Column:
    """Binary cross-entropy on the logit, in the form that cannot overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def focal_loss(logit: Column, target: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    loss = cross_entropy(logit, target)
    confidence = F.greatest(F.exp(-loss), F.lit(1e-9))
    balance = F.lit(alpha) * target + F.lit(1.0 - alpha) * (F.lit(1.0) - target)
    return balance * F.pow(F.lit(1.0) - confidence, F.lit(float(gamma))) * loss


def reduce_loss(loss: Column, reduction: str = "mean") -> Column:
    if reduction == "mean":
        return F.avg(loss)
    if reduction == "sum":
        return F.sum(loss)
    return loss


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
