"""Files as sets of chunks: lists, contents, neighbours, outlines, related files, summaries, quotas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import extension, sentences, tokens


def list_files(chunks: DataFrame, sort: str = "name", limit: int | None = None, path: str = "path") -> DataFrame:
    """Per file with an extension: chunks, size in KiB and the newest time."""
    rows = chunks.where(extension(F.col(path)) != "").groupBy(path).agg(F.count("*").alias("chunks"), (F.sum(F.octet_length("content")) / 1024).alias("size_kb"))
    order = {"name": [F.col(path)], "size": [F.desc("size_kb"), F.col(path)], "chunks": [F.desc("chunks"), F.col(path)]}[sort]
    rows = rows.orderBy(*order)
    return rows.limit(limit) if limit else rows


def joined_text(parts: list[str], most: int = 512) -> str:
    """Chunks in order with what the end of one and the start of the next have in common once."""
    out: list[bytes] = []
    tail = b""
    for part in parts:
        raw = part.encode()
        n = overlap(tail, raw)
        out.append(raw[n:])
        tail = (tail + raw[n:])[-most:]
    return b"".join(out).decode("utf-8", "replace")


def overlap(tail: bytes, head: bytes) -> int:
    """The length of the longest end of ``tail`` that ``head`` starts with."""
    tail = tail[-len(head) :] if head else b""
    at = 0
    while at < len(tail):
        if head.startswith(tail[at:]):
            return len(tail) - at
        step = tail.find(head[:4], at + 1) if len(tail) - at > 4 else at + 1
        at = step if step >= 0 else max(at + 1, len(tail) - 3)
    return 0


def contents(chunks: DataFrame, path: str = "path") -> DataFrame:
    """Each file's text from its chunks; a file's chunks are one row, as a file is one text."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                some = batch.slice(start, 256)
                texts = [joined_text([p["content"] for p in parts.as_py()]) for parts in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string())], names=["path", "content"])

    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("parts")
    return chunks.groupBy(F.col(path).alias("path")).agg(parts).mapInArrow(build, "path string, content string")


def ordered_chunks(chunks: DataFrame, hint: int = 50, path: str = "path") -> DataFrame:
    """Chunks with the first characters of their neighbours."""
    order = Window.partitionBy(path).orderBy("chunk_index")
    head = F.substring("content", 1, hint)
    return chunks.withColumn("before", F.lag(head).over(order)).withColumn("after", F.lead(head).over(order))


def outline(chunks: DataFrame, path: str = "path") -> DataFrame:
    """Per directory and extension: files and chunks."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return chunks.groupBy(folder.alias("folder"), extension(F.col(path)).alias("extension")).agg(F.countDistinct(path).alias("files"), F.count("*").alias("chunks"))


def related_files(hits: DataFrame, own: str, least: float, limit: int, path: str = "path") -> DataFrame:
    """Other files by the mean score of their hits."""
    rows = hits.where(F.col(path) != own).groupBy(path).agg(F.round(F.avg("score"), 6).alias("score"), F.count("*").alias("chunks"))
    return rows.where(F.col("score") >= least).orderBy(F.desc("score"), path).limit(limit)


def extractive(docs: DataFrame, key: str, text: str, n: int = 5, least: int = 20) -> DataFrame:
    """The first n sentences of more than ``least`` characters."""
    return docs.select(key, F.slice(sentences(F.col(text), least), 1, n).alias("summary"))


def structural(docs: DataFrame, key: str, text: str, n: int = 10) -> DataFrame:
    """Headings and list points of a text."""
    lines = F.split(F.col(text), "\n")
    return docs.select(key, F.slice(F.filter(lines, lambda x: x.rlike(r"^#{1,6} ")), 1, n).alias("headings"), F.slice(F.filter(lines, lambda x: x.rlike(r"^\s*[-*] ")), 1, n).alias("points"))


def spaced_sentences(docs: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """n sentences at even distances."""
    s = sentences(F.col(text), 0)
    return docs.select(key, F.when(F.size(s) <= n, s).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(s, (F.floor(i * F.size(s) / n) + 1).cast("int")))).alias("summary"))


def keyword_summary(docs: DataFrame, key: str, text: str, n: int = 10, least: int = 4) -> DataFrame:
    """The n most frequent words of ``least`` letters or more."""
    each = docs.select(key, F.explode(tokens(F.col(text))).alias("term")).where(F.length("term") >= least)
    best = Window.partitionBy(key).orderBy(F.desc("n"), "term")
    return each.groupBy(key, "term").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def quota(usage: DataFrame, limit: int, used: str = "used", asked: str = "asked") -> DataFrame:
    """Whether what is asked for still fits."""
    return usage.withColumn("allowed", F.col(used) + F.col(asked) <= limit).withColumn("left", F.greatest(F.lit(limit) - F.col(used), F.lit(0)))
