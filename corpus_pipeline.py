"""The training-corpus pipeline: stages over ``documents``, each written as Parquet and read again.

1. language ID: documents without letters, or unlike every learnt language, go;
2. n-gram Jaccard join: of each group one row stays, that with the smallest id (rows without one come last);
3. benchmark decontamination: benchmark passages are cut out of texts, and documents that are
   mostly such passages go;
4. PII: every span found is replaced by the name of its kind;
5. mixing: what is left is given training positions and the words to take.
All but the last return the columns of ``documents``; ``n_chars`` follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.store import cut
from quillon.llm import decontaminate, jaccard, language, mixing, pii
from quillon.llm.common import held_out, small_batches, table

#: A text whose best cosine is below this is like none of the learnt languages.
LEAST_COSINE = 0.05


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    profiles = language.fit(docs, train=~held_out("id"))
    judged = language.predict(docs, profiles, keep=tuple(docs.columns), as_lang="__lang", as_score="__score")
    return judged.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_COSINE)).select(docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")
    joined = jaccard.join(rows, doc_id="__row").select(F.col("doc_id").alias("__row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))
    stay = joined.join(rows.select("__row", "doc_id"), "__row").groupBy("component_id").agg(first.alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(stay, "__row", "left_semi").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    cleaned = decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


STAGES = [("language", language_stage), ("jaccard", jaccard_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("mixing", mixing_stage)]

#: Learnt languages and discovered identifiers cannot be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
