"""Model scores to probabilities and classes, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flareframe.functions.arrays import let


def sigmoid(x: Column) -> Column:
    """Logistic function that never overflows."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def _shifted(a: Column) -> Column:
    return let(a, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: x - top)))


def _normalised(a: Column) -> Column:
    return let(a, lambda v: let(_sum(v), lambda n: F.transform(v, lambda x: x / n)))


def softmax(a: Column) -> Column:
    return _normalised(F.transform(_shifted(a), F.exp))


def log_softmax(a: Column) -> Column:
    return let(_shifted(a), lambda d: let(
        F.log(_sum(F.transform(d, F.exp))), lambda n: F.transform(d, lambda x: x - n)))


def argmax(a: Column) -> Column:
    """0-based position of the maximum, first on ties."""
    return let(a, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int"))


def binary_class(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p >= threshold, 1).otherwise(0)


def two_class(probs: Column, threshold: float = 0.5) -> Column:
    """Class of a [P(neg), P(pos)] pair by a threshold on P(pos)."""
    return binary_class(F.get(probs, F.lit(1)), threshold)


def multilabel_flags(a: Column, threshold: float = 0.5) -> Column:
    return F.transform(a, lambda x: binary_class(sigmoid(x), threshold))


def exceedance(a: Column, monotone: bool) -> Column:
    """P(class >= k) from K-1 cumulative logits, optionally forced non-increasing."""
    p = F.transform(a, sigmoid)
    if not monotone:
        return p
    return let(p, lambda q: F.transform(q, lambda _, i: F.array_min(F.slice(q, F.lit(1), i + 1))))


def ordinal_probs(a: Column, monotone: bool = True) -> Column:
    """K class probabilities from K-1 cumulative logits, floored at 1e-12, summing to 1."""
    edges = F.concat(F.array(F.lit(1.0)), exceedance(a, monotone), F.array(F.lit(0.0)))
    raw = let(edges, lambda e: F.transform(
        F.sequence(F.lit(0), F.size(e) - 2),
        lambda i: F.greatest(F.get(e, i) - F.get(e, i + 1), F.lit(1e-12))))
    return _normalised(raw)


def ordinal_class(a: Column, thresholds: Sequence[float] | None = None) -> Column:
    """Class as the number of passed thresholds (0.5 each by default)."""
    p = F.transform(a, sigmoid)
    if thresholds is None:
        return F.size(F.filter(p, lambda x: x >= 0.5))
    t = F.array(*[F.lit(float(x)) for x in thresholds])
    return F.size(F.filter(p, lambda x, i: x >= F.get(t, i)))


def name_of(idx: Column, labels: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(s) for s in labels]), idx)
