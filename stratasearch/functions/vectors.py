"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def doubles(vector: Column | str) -> Column:
    return col(vector).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column | str) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(vector, vector))


def normalize(vector: Column | str) -> Column:
    """Length one; vectors of (almost) no length stay."""
    size = norm(vector)
    by = F.when(size <= 1e-9, F.lit(1.0)).otherwise(size)
    return F.transform(doubles(vector), lambda x: x / by)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column | str, b: Column | str, metric: str) -> Column:
    """ip and cosine as they are; l2 as 1 / (1 + squared distance)."""
    if metric == "ip":
        return dot(a, b)
    if metric == "cosine":
        return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    if metric == "l2":
        return 1.0 / (1.0 + squared_distance(a, b))
    raise ValueError(f"unknown metric {metric!r}")
