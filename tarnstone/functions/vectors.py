"""Vector arithmetic in expressions; components are doubles before anything is summed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector at length one; null for a zero vector. Stored so, cosine is one dot product."""
    n = norm(doubles(a))
    return F.when(n > 0, F.transform(doubles(a), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(doubles(a), doubles(b)) / (norm(doubles(a)) * norm(doubles(b)))
