"""Structured Streaming jobs: change files, expiry, usage windows, incremental ingest.

Every job takes a streaming DataFrame and gives a query or a DataFrame; state is bounded by
watermarks, sinks are foreachBatch upserts of Parquet tables that can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.dml import unexpired, upsert


def changes(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 1000, form: str = "parquet") -> DataFrame:
    """New files under ``path`` as a stream; ``files_a_trigger`` is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).format(form).load(path)


def last_of_batch(batch: DataFrame, key: str, order: str) -> DataFrame:
    """Debouncing: of each key the last event of a batch."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return batch.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def upserts(stream: DataFrame, root: str, checkpoint: str, key: str = "id", order: str = "seq", now_ms: Callable[[], int] | None = None) -> StreamingQuery:
    """Keep a versioned Parquet table of the last row of each key: batch n writes ``root/version=n``
    from the version before it, so a batch that runs again gives the same.  Rows with op
    ``delete`` go, and with ``now_ms`` those whose ``expires_at`` has come."""

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fresh = last_of_batch(batch, key, order)
        state = upsert(spark.read.parquet(f"{root}/version={n - 1}"), fresh, key, order) if n else fresh
        state = state.where("op <> 'delete'") if "op" in state.columns else state
        state = unexpired(state, now_ms()) if now_ms else state
        state.write.mode("overwrite").parquet(f"{root}/version={n}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_contents(batch: DataFrame, known: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files of a batch whose content hash is not the known one for their path."""
    rows = batch.withColumn("hash", F.sha2(content, 256))
    return rows.join(known.select(path, "hash"), [path, "hash"], "left_anti")


def usage(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes", by: str = "event_type", ts: str = "ts") -> DataFrame:
    """Counts and sums by window and ``by``; windows close when the watermark passes."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(by, F.window(ts, size).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def once(stream: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def since(log: DataFrame, offset: int, kept_from: int) -> tuple[str, DataFrame]:
    """Replication: the part after ``offset``, or everything if the log no longer reaches back to it."""
    if offset + 1 < kept_from:
        return "full", log
    return "partial", log.where(F.col("seq") > offset)


def drain(df: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there to the end and give its result as a table (for bounded results, as tests have)."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
