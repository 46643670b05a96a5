"""Vector expressions: products and distances in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

D = "array<double>"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast(D), b.cast(D), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast(D), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is all zero or of another length."""
    n = norm(a) * norm(b)
    return F.when((n > 0) & (F.size(a) == F.size(b)), dot(a, b) / n)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a.cast(D), b.cast(D), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def fault(v: Column, size: int) -> Column:
    """missing, size, nan, zero, norm, flat, or null for a usable vector."""
    n = norm(v)
    mean = F.aggregate(v.cast(D), F.lit(0.0), lambda s, x: s + x) / F.size(v)
    spread = F.aggregate(v.cast(D), F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(v)
    return (
        F.when(v.isNull(), "missing").when(F.size(v) != size, "size")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "nan")
        .when(n == 0, "zero").when((n < 0.01) | (n > 1000), "norm").when(spread < 1e-10, "flat")
    )


def quantized(v: Column, bound: float) -> Column:
    """Numbers in int8 steps of bound / 127, cut at the bound."""
    return F.transform(v, lambda x: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x / bound)) * 127).cast("byte"))
