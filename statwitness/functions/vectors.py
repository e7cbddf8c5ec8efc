"""Column functions on numeric arrays (JVM side, no Python)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when one vector is all zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance (what a flat L2 index reports)."""

    def gap(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d

    return _sum(F.zip_with(a, b, gap))


def similarity_from_distance(d: Column) -> Column:
    return 1.0 / (1.0 + d)
