"""Dense vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def finite(x: Column) -> Column:
    """Null counts as not finite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def violation(v: Column, dim: int) -> Column:
    """'dimension', 'not_finite' or null."""
    return F.when(v.isNull() | (F.size(v) != dim), "dimension").when(~F.forall(v, finite), "not_finite")
