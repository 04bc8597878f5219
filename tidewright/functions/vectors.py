"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of the two widths."""
    n = F.least(F.size(a), F.size(b))
    paired = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(paired, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def scaled(a: Column) -> Column:
    """Of unit length, in double precision; zeros stay. The length is worked out once a vector, not once a component: it is no part of the lambda."""
    return F.zip_with(a, F.array_repeat(norm(a), F.size(a)), lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Normalised dot product; 0 if either has no length."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def is_unit(a: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(norm(a) * norm(a) - 1) <= tolerance
