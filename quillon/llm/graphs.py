"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.store import cut, drop


def stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (a above b) is either a centre or has exactly one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below")))
    return not ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below")).where("above > 1 or above + below > 1").take(1)


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of ``links`` (a, b: long).

    Minima are taken with partial sums; a node with a great many links only meets them in
    joins, which Spark splits.  Every round is written to the shared folder, and deleted once the
    next one is; rounds end when only stars are left.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges, "cc")
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        before, edges = edges, cut(small.distinct(), "cc")
        drop(before)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
