"""Dense vector kernels as Column expressions.  Sums are in double, from the first component on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def clamped_cosine(a: Column, b: Column) -> Column:
    """Cosine of vectors that are already normalised."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def normalize(v: Column) -> Column:
    """Unchanged where the norm is 0 or not finite."""
    n = norm(v)
    good = (n > 0) & (n < float("inf"))
    return F.when(good, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def scale(v: Column, by: float | Column) -> Column:
    return F.transform(doubles(v), lambda x: x * by)


def argmin(v: Column) -> Column:
    """Index of the smallest component, from 0; the first of equals."""
    return F.array_position(v, F.array_min(v)).cast("int") - 1


def int8_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)


def search_score(metric: str, a: Column, b: Column) -> Column:
    """The score of every search: cosine itself, a sigmoid of the dot product, 1 / (1 + distance)."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot":
        return 1 / (1 + F.exp(-dot(a, b)))
    if metric == "euclidean":
        return 1 / (1 + euclidean(a, b))
    raise ValueError(f"unknown metric {metric}")


def distance_score(metric: str, distance: Column) -> Column:
    """The utility's own conversion of a distance, unlike that of searches."""
    if metric == "cosine":
        return (distance + 1) / 2
    return F.exp(-distance) if metric == "euclidean" else 1 / (1 + F.exp(-distance))


def matrix_score(metric: str, a: Column, b: Column) -> Column:
    """The score of similarity matrices: norms of 1e-10 at least, negative distance, raw dot product."""
    if metric == "cosine":
        return dot(a, b) / (F.greatest(norm(a), F.lit(1e-10)) * F.greatest(norm(b), F.lit(1e-10)))
    return -euclidean(a, b) if metric == "euclidean" else dot(a, b)
