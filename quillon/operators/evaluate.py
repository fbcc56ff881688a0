"""Search quality: precision and recall curves, average precision, reciprocal rank, their means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def curves(results: DataFrame, truth: DataFrame, by: str = "query_id", key: str = "doc_id") -> DataFrame:
    """``results`` (query, key, rank) against ``truth`` (query, key): at each rank hits, precision
    at k, recall, and the curve's precision, which only moves at relevant ranks (before the
    first it is 0)."""
    size = truth.groupBy(by).agg(F.countDistinct(key).alias("relevant"))
    marked = results.join(truth.select(by, key).distinct().withColumn("hit", F.lit(1)), [by, key], "left").withColumn("hit", F.coalesce("hit", F.lit(0))).join(size, by, "left")
    return marked_curves(marked, by)


def label_curves(results: DataFrame, labelled: DataFrame, by: str = "query_id", key: str = "doc_id", label: str = "label", own: str = "query_label") -> DataFrame:
    """``curves`` where all other rows of a query's own label are relevant: they are counted by label, not listed by query."""
    size = labelled.groupBy(F.col(label).alias(own)).agg((F.countDistinct(key) - 1).alias("relevant"))
    marked = results.withColumn("hit", F.coalesce((F.col(label) == F.col(own)).cast("int"), F.lit(0))).join(size, own, "left")
    return marked_curves(marked.withColumn("relevant", F.nullif("relevant", F.lit(0))), by)


def marked_curves(marked: DataFrame, by: str = "query_id") -> DataFrame:
    """The curves of results marked with ``hit`` and the number ``relevant``."""
    upto = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = marked.withColumn("hits", F.sum("hit").over(upto)).withColumn("precision_at_k", F.col("hits") / F.col("rank"))
    own = F.coalesce(F.last(F.when(F.col("hit") == 1, F.col("precision_at_k")), ignorenulls=True).over(upto), F.lit(0.0))
    return rows.withColumn("curve", own).withColumn("recall", F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0))


def by_query(curve: DataFrame, by: str = "query_id") -> DataFrame:
    """Average precision (over all relevant) and reciprocal rank of the first hit."""
    hit = F.col("hit") == 1
    return curve.groupBy(by).agg(F.coalesce(F.sum(F.when(hit, F.col("precision_at_k"))) / F.max("relevant"), F.lit(0.0)).alias("ap"), F.coalesce(1 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr"))


def overall(queries: DataFrame) -> DataFrame:
    return queries.agg(F.avg("ap").alias("map"), F.avg("rr").alias("mrr"), F.count("*").alias("queries"))
