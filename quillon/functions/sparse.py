"""Sparse vectors: struct<indices:array<int>, values:array<double>>, and postings (id, idx, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import total


def from_dense(v: Column) -> Column:
    pairs = F.filter(F.zip_with(F.sequence(F.lit(0), F.size(v) - 1), v.cast("array<double>"), lambda i, x: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"] != 0)
    return F.struct(F.transform(pairs, lambda p: p["i"]).alias("indices"), F.transform(pairs, lambda p: p["x"]).alias("values"))


def to_dense(s: Column, dim: int) -> Column:
    """Indices of ``dim`` or more are ignored."""
    by_index = F.map_from_arrays(s["indices"], s["values"])
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(by_index, i), F.lit(0.0)))


def nnz(s: Column) -> Column:
    return F.size(s["indices"])


def sparsity(s: Column, dim: int) -> Column:
    return F.lit(0.0) if dim == 0 else 1 - nnz(s) / F.lit(float(dim))


def dot(a: Column, b: Column) -> Column:
    of_b = F.map_from_arrays(b["indices"], b["values"])
    return total(F.zip_with(a["indices"], a["values"], lambda i, x: x * F.coalesce(F.try_element_at(of_b, i), F.lit(0.0))))


def norm(s: Column) -> Column:
    return F.sqrt(total(F.transform(s["values"], lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def valid(s: Column) -> Column:
    """As many indices as values, ascending and distinct."""
    i = s["indices"]
    rising = F.forall(F.zip_with(F.slice(i, F.lit(1), F.greatest(F.size(i) - 1, F.lit(0))), F.slice(i, F.lit(2), F.greatest(F.size(i) - 1, F.lit(0))), lambda a, b: a < b), lambda x: x)
    return (F.size(i) == F.size(s["values"])) & rising


def postings(df: DataFrame, key: str, s: str) -> DataFrame:
    """The inverted index: one row (key, idx, val) for each entry."""
    return df.select(key, F.inline(F.arrays_zip(F.col(s)["indices"].alias("idx"), F.col(s)["values"].alias("val"))))


def scores(df: DataFrame, query: DataFrame, key: str, s: str) -> DataFrame:
    """key and dot product with one query vector (idx, val).  Vectors without an entry in
    common count too, with score 0; the query's side is as short as a query is."""
    shared = postings(df, key, s).join(F.broadcast(query.select("idx", F.col("val").alias("q"))), "idx").groupBy(key).agg(F.sum(F.col("val") * F.col("q")).alias("score"))
    return df.select(key).join(shared, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def top_k(df: DataFrame, query: DataFrame, key: str, s: str, k: int) -> DataFrame:
    """The k best of ``scores``, ties to the smaller key: a heap of k rows a partition."""
    return scores(df, query, key, s).orderBy(F.desc("score"), key).limit(k)
