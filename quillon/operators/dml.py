"""Changes to collections as DataFrames: each operator gives the new state; writing it is the caller's."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def upsert(current: DataFrame, changes: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last change of each id over the current row."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc("__new"), F.desc(order))
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__new")


def update(current: DataFrame, changes: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows replaced, and the ids that do not exist."""
    known = changes.join(current.select(key), key, "left_semi")
    return current.join(changes.select(key), key, "left_anti").unionByName(known), changes.join(current.select(key), key, "left_anti").select(key)


def delete(current: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    return current.join(ids, key, "left_anti"), ids.join(current.select(key), key, "left_anti")


def delete_where(current: DataFrame, where: Column | None) -> DataFrame:
    if where is None:
        raise ValueError("an empty filter would delete everything")
    return current.where(~F.coalesce(where, F.lit(False)))


def batch_status(current: DataFrame, asked: DataFrame, dim: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """Each item of a batch with ``ok`` or what is wrong with it."""
    known = current.select(F.col(key), F.lit(True).alias("__known"))
    status = F.when((F.col("op") == "insert") & (F.size(vector) != dim), "invalid dimension").when(F.col("op").isin("update", "delete") & F.col("__known").isNull(), "not found").otherwise("ok")
    return asked.join(known, key, "left").withColumn("status", status).drop("__known")


def move(source: DataFrame, target: DataFrame, ids: DataFrame, key: str = "id", copy: bool = False) -> tuple[DataFrame, DataFrame]:
    """Source and target after rows went over; of equal ids the moved row wins."""
    going = source.join(ids, key, "left_semi")
    there = target.join(going.select(key), key, "left_anti").unionByName(going)
    return (source if copy else source.join(ids, key, "left_anti")), there


def merged_json(target, patch):
    """A JSON merge patch: null deletes, objects merge, all else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merged_json(out.get(k), v)
    return out


def merge_patch(payload: Column, patch: Column) -> Column:
    @F.pandas_udf(StringType())
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if p is None and q is None else json.dumps(merged_json(json.loads(p or "{}"), json.loads(q or "{}")), separators=(",", ":"), ensure_ascii=False, sort_keys=True) for p, q in zip(a, b, strict=True)])

    return apply(payload, patch)


def set_payload(payload: Column, more: Column) -> Column:
    """Shallow merge of flat JSON objects, the new values winning, in SQL."""
    a, b = F.from_json(payload, "map<string,string>"), F.from_json(more, "map<string,string>")
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)))))


def delete_keys(payload: Column, keys: list[str]) -> Column:
    return F.to_json(F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, v: ~k.isin(keys)))


def unexpired(rows: DataFrame, now_ms: int, expires: str = "expires_at") -> DataFrame:
    """Rows whose time has not come; without one they stay."""
    return rows.where(F.col(expires).isNull() | (F.col(expires) > now_ms))


def overlap(old: DataFrame, new: DataFrame, by: str = "query_id", key: str = "vec_id") -> DataFrame:
    """Quality of a rebuilt index: Jaccard of the results of each query and mean score difference."""
    a, b = old.select(by, key, F.col("score").alias("s")), new.select(by, key, F.col("score").alias("t"))
    both = a.join(b, [by, key], "full_outer")
    return both.groupBy(by).agg(F.round(F.count(F.when(F.col("s").isNotNull() & F.col("t").isNotNull(), 1)) / F.count("*"), 6).alias("jaccard"), F.round(F.avg(F.abs(F.col("s") - F.col("t"))), 6).alias("score_diff"))


def replay(log: DataFrame, after: int = 0, key: str = "id") -> DataFrame:
    """The state that a log (seq, op, key, ...) leaves: the last operation of each id, if no delete."""
    last = Window.partitionBy(key).orderBy(F.desc("seq"))
    return log.where(F.col("seq") > after).withColumn("__n", F.row_number().over(last)).where("__n = 1 and op <> 'delete'").drop("__n", "op")
