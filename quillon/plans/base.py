"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) as a query, with its SQL where there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        own = name or f.__name__
        QUERIES[own] = f
        if sql:
            SQL[own] = sql
        return f

    return add
