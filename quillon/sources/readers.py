"""Reading and writing collections: Parquet, JSON lines, text folders, HTML, archives, snapshots, logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import chunks


def collection(spark: SparkSession, path: str) -> DataFrame:
    """A collection in its own order: rows as stored, with ``place`` where it was written with one."""
    return spark.read.parquet(path)


def save(df: DataFrame, path: str, mode: str = "errorifexists", shards: int | None = None, key: str = "id") -> None:
    """Write a collection; ``shards`` deals rows out by a hash of the key into folders that filters prune."""
    if shards:
        df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")).write.mode(mode).partitionBy("shard").parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def page(df: DataFrame, limit: int, offset: int, key: str = "id", content: str | None = None, least: float | None = None) -> DataFrame:
    """A page in key order: 50 rows and an offset of a million at most; ``least`` asks for
    min(1, bytes / 1000) of ``content``."""
    if content and least is not None:
        df = df.where(F.least(F.lit(1.0), F.octet_length(content) / 1000) >= least)
    return df.orderBy(key).offset(min(offset, 1_000_000)).limit(min(limit, 50))


def folder(spark: SparkSession, path: str, include: str = "*", size: int = 2048, overlap: int = 256) -> DataFrame:
    """Chunks of the text files under a folder."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", include).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return chunks(files, "path", "text", size, overlap)


def markdown(html: Column) -> Column:
    """HTML as simple markdown: headings, list points, links; no scripts, styles or other tags."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->|<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>|<head[^>]*>.*?</head>", "")
    for n in range(6, 0, -1):
        out = F.regexp_replace(out, rf"(?i)<h{n}[^>]*>", "\n" + "#" * n + " ")
    out = F.regexp_replace(out, r"(?i)<li[^>]*>", "\n- ")
    out = F.regexp_replace(out, r"""(?is)<a\s[^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>""", "[$2]($1)")
    out = F.regexp_replace(out, r"(?i)</(p|div|h[1-6]|ul|ol|table|tr|article|section)>|<br[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]*\n\s*\n\s*", "\n\n"), r"^\s+|\s+$", "")


def snapshot(df: DataFrame, root: str, version: int) -> str:
    """A copy of a collection under ``root/version=n``; earlier ones stay."""
    df.write.mode("errorifexists").parquet(f"{root}/version={version}")
    return f"{root}/version={version}"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions under ``root``, by Spark's own listing, so any store works."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
    return sorted(int(m[1]) for m in map(re.compile(r"version=(\d+)$").match, names) if m)


def restore(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version (the last, unless named) of a collection."""
    known = versions(spark, root)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no version {version} under {root}")
    return spark.read.parquet(f"{root}/version={version if version is not None else known[-1]}")


POINTS = "id string, vector array<float>, payload string"


def export_json(df: DataFrame, path: str) -> None:
    """Points as JSON lines {id, vector, payload}; the payload is an object, not a string."""
    df.select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), "vector", F.try_parse_json("payload").alias("payload"))).alias("value")).write.text(path)


def import_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    return raw.select(F.try_variant_get("v", "$.id", "string").alias("id"), F.try_variant_get("v", "$.vector", "array<float>").alias("vector"), F.to_json(F.try_variant_get("v", "$.payload", "variant")).alias("payload"))


def append_log(df: DataFrame, path: str) -> None:
    """Operations (seq, op, id, ...) with a checksum of each, appended."""
    df.withColumn("crc", F.crc32(F.to_json(F.struct(*df.columns)).cast("binary"))).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The operations whose checksum holds."""
    rows = spark.read.parquet(path)
    own = [c for c in rows.columns if c != "crc"]
    return rows.where(F.crc32(F.to_json(F.struct(*own)).cast("binary")) == F.col("crc")).drop("crc")
