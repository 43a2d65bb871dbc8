"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """M01"""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """M02"""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def problem(a: Column, dim: int, tolerance: float = 1e-4) -> Column:
    """The first problem of a stored vector; null if it is finite, of its dimension and of unit length."""
    return (
        F.when(a.isNull(), "missing")
        .when(F.size(a) != dim, "dimension")
        .when(F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
        .when(F.abs(norm(a) - 1) > tolerance, "norm")
    )


def softmax(z: Column) -> Column:
    """M04"""
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def calibrated(x: Column, weights: list[float], intercept: float, a: float, b: float) -> Column:
    """1 / (1 + exp(a (w x + intercept) + b))."""
    z = dot(x, F.array(*(F.lit(float(w)) for w in weights))) + intercept
    return 1 / (1 + F.exp(z * a + b))


def pair_label(entail: Column, contradict: Column, high: float = 0.7, low: float = 0.3, against: float = 0.5) -> Column:
    """M05"""
    return F.when(contradict >= against, "contradicted").when(entail >= high, "supported").when(entail < low, "unsupported").otherwise("uncertain")
