"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts a batch on their way to Python: about 2 MB of common texts, where Spark's 10,000 rows are buffers of 32 MB outside the heap.
TEXT_ROWS = 1024
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on no Arrow batch of this session has more than ``TEXT_ROWS`` rows."""
    rows = int(spark.conf.get(BATCH))
    spark.conf.set(BATCH, str(TEXT_ROWS if rows <= 0 else min(rows, TEXT_ROWS)))


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """``small_batches`` for what is run within."""
    before = spark.conf.get(BATCH)
    small_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the ids that nothing is learnt from: crc32(id as text) mod 5 = 0."""
    return F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(-1)).cast("string").cast("binary")) % 5 == 0


def sample_share(df: DataFrame, ids: Column, by: str, bound: int) -> DataFrame:
    """Of every value of ``by`` about ``bound`` rows at most, chosen by a hash of ``ids`` against
    the value's count, so the choice is the same in every run and needs no sort."""
    counts = df.groupBy(by).agg(F.count("*").alias("__rows"))
    keep = F.pmod(F.xxhash64(ids, F.lit("sample")), F.lit(1 << 30)) < F.lit(float(1 << 30)) * bound / F.col("__rows")
    return df.join(F.broadcast(counts), by).where(keep).drop("__rows")


def shared(spark: SparkSession, thing) -> Callable:
    """Broadcast the fields of an object; what comes back makes it anew on a worker.  (Plain
    values travel without this package, an object of one of its classes would not.)"""
    held, kind = spark.sparkContext.broadcast(vars(thing)), type(thing)

    def get():
        out = kind.__new__(kind)
        out.__dict__.update(held.value)
        return out

    return get


def bit_set(hashes: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """A set of 2**bits marks (so of bounded size) with the low bits of each hash set, gathered by
    words of 64; it may hold more than was put in, never less."""
    word = F.expr(f"cast(shiftright(`{column}` & {(1 << bits) - 1}L, 6) as int) as word")
    marks = F.expr(f"bit_or(shiftleft(1L, cast(`{column}` & 63L as int))) as marks")
    words = hashes.where(F.col(column).isNotNull()).groupBy(word).agg(marks).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["marks"].to_numpy()
    return out.view(np.uint64)


def in_bit_set(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes.astype(np.uint64, copy=False) & np.uint64(len(marks) * 64 - 1)
    return (marks[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1
