"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, training token
windows scanned against it, hits verified word by word, spans or documents removed.

Words are the maximal runs of ASCII digits and letters and of all non-ASCII characters, with
A-Z lower-cased.  An item's windows are its ``width`` consecutive words; an item of fewer
words, but not none, is one window of all of them.

Defined cases: null or wordless texts have no words and no hits; items without words have no
windows; repeated items count once by id; repeated documents are judged each on its own; an
empty benchmark leaves every document clean.  Columns beyond id and text are ignored.

Memory: the benchmark is dealt into parts of at most ``part_words`` words (a part of one bucket of
ids may have more), each broadcast on its own and scanned for in a pass of its own, so what an
executor holds does not grow with the benchmark; an ordinary benchmark is one part and one pass.
Every pass reads the original texts, and what all parts hit of a row is gathered under a number
of the row before anything is judged or cut: the number of parts changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.store import cut
from quillon.llm.common import shared
from quillon.llm.words import LOWER, NOT_ALNUM, U, buffers, runs, shingled, words

WIDTH = 10
FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>, items array<string>"


def item_words(texts: pa.Array) -> list[list[bytes]]:
    """The normalised words of each text."""
    data, at = buffers(texts)
    _, s, e, start = words(data, at, NOT_ALNUM)
    low = LOWER[data].tobytes()
    return [[low[a:b] for a, b in zip(s[i:j], e[i:j], strict=True)] for i, j in zip(start[:-1], start[1:], strict=True)]


class Windows:
    """One part of the benchmark's windows, ready to be looked up."""

    BITS = 1 << 22

    def __init__(self, ids: list[str], texts: list[str | None], width: int):
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.owners: dict[tuple[bytes, ...], set[str]] = {}
        for i, own in zip(ids, item_words(pa.array(texts, pa.string())), strict=True):
            w = min(width, len(own))
            for k in range(len(own) - w + 1 if own else 0):
                self.owners.setdefault(tuple(own[k : k + w]), set()).add(i)
        for w in {len(x) for x in self.owners}:
            some = [x for x in self.owners if len(x) == w]
            column = pa.array([b" ".join(x) for x in some], pa.binary()).cast(pa.string())
            data, at = buffers(column)
            h, _, _, start = words(data, at, NOT_ALNUM)
            keys = np.unique(np.concatenate([shingled(h[a:b], w) for a, b in zip(start[:-1], start[1:], strict=True)]))
            bits = np.zeros(self.BITS, bool)
            bits[(keys % U(self.BITS)).astype(np.int64)] = True
            self.by_width[w] = keys, bits

    def hits(self, w: int, h: np.ndarray) -> np.ndarray:
        """Starts in ``h`` of windows whose hash is known."""
        keys, bits = self.by_width[w]
        grams = shingled(h, w)
        maybe = np.flatnonzero(bits[(grams % U(self.BITS)).astype(np.int64)])
        at = np.searchsorted(keys, grams[maybe])
        return maybe[keys[np.minimum(at, len(keys) - 1)] == grams[maybe]]


def scan(batches: Iterator[pa.RecordBatch], known: Windows) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_words", "spans", "items")}
        data, at = buffers(batch.column(1))
        for first, last in runs(at):
            b = data[at[first] : at[last]]
            h, s, e, start = words(b, at[first : last + 1] - at[first], NOT_ALNUM)
            own: dict[int, tuple[list, set]] = {}
            for w in known.by_width:
                for k in known.hits(w, h):
                    doc = int(np.searchsorted(start, k, "right")) - 1
                    if k + w > start[doc + 1]:
                        continue  # runs over into the next document
                    items = known.owners.get(tuple(LOWER[b[s[j] : e[j]]].tobytes() for j in range(k, k + w)))
                    if items:
                        spans, found = own.setdefault(doc, ([], set()))
                        spans.append((int(k - start[doc]), int(k - start[doc]) + w))
                        found |= items
            for doc in range(last - first):
                spans, found = own.get(doc, ([], set()))
                out["n_words"].append(int(start[doc + 1] - start[doc]))
                out["spans"].append([{"start": a, "end": z} for a, z in merged(spans)])
                out["items"].append(sorted(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(out["items"], pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def parts(benchmark: DataFrame, item_id: str, text: str, part_words: int) -> list[DataFrame]:
    """The benchmark's items (id, text) in parts of bounded size: whole buckets of ids, as many as fit."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id is not null")
    count = F.sum(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long")).alias("n")
    total = rows.agg(count).first()[0] or 0
    if total <= part_words:
        return [rows]
    bucket = F.pmod(F.xxhash64("id"), F.lit(16 * -(-total // part_words)))
    ends, held = [], 0
    counted = sorted(map(tuple, rows.groupBy(bucket.alias("k")).agg(count).collect()))
    for k, n in counted:
        if not ends or held + n > part_words:
            ends.append([k, k])
            held = 0
        ends[-1][1] = k
        held += n
    return [rows.where(bucket.between(a, z)) for a, z in ends]


def _windows(items: DataFrame, width: int) -> Windows:
    got = items.toPandas()
    return Windows(got["id"].tolist(), got["text"].tolist(), width)


def _scanned(rows: DataFrame, key: str, text: str, split: list[DataFrame], width: int) -> DataFrame:
    """doc_id (the key), n_words, spans and items of each row, over all parts; with several parts the
    key must tell rows apart."""
    every = []
    for items in split:
        get = shared(rows.sparkSession, _windows(items, width))
        every.append(rows.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda batches, get=get: scan(batches, get()), "doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"))
    if len(every) == 1:
        return every[0]
    out = every[0]  # this one has every row, of the others only hits are needed
    for one in every[1:]:
        out = out.unionByName(one.where(F.size("spans") > 0))
    return out.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _numbered(docs: DataFrame) -> DataFrame:
    return cut(docs.withColumn("__row", F.monotonically_increasing_id()), "decontaminate-rows")


def _merged(spans: str) -> Column:
    """Sorted spans, those that touch or overlap as one."""
    last = lambda a: F.try_element_at(a, F.lit(-1))
    span = lambda a, z: F.array(F.struct(a.alias("start"), z.alias("end")))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,end:int>>"), lambda a, x: F.when((F.size(a) > 0) & (last(a)["end"] >= x["start"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), span(last(a)["start"], F.greatest(last(a)["end"], x["end"])))).otherwise(F.concat(a, span(x["start"], x["end"]))))


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, part_words: int = 1_000_000) -> DataFrame:
    """Per document: n_words, n_hit (words inside hits), n_items, items_sha256, contaminated, and
    the hit spans (word numbers, end exclusive) and items themselves."""
    split = parts(benchmark, item_id, item_text, part_words)
    if len(split) == 1:
        scanned = _scanned(docs, doc_id, text, split, width)
    else:
        rows = _numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
        own = _scanned(rows, "__row", "text", split, width).withColumnRenamed("doc_id", "__row").withColumn("spans", _merged("spans"))
        scanned = rows.select("doc_id", "__row").join(own, "__row")
    last = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("at")), lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["at"]), F.lit(0))).alias("n"), F.greatest(a["at"], x["end"]).alias("at")))
    items = F.array_sort("items")
    return scanned.select("doc_id", "n_words", last["n"].alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), F.array_sort("spans").alias("spans"), items.alias("items"))


def _without(text: str, spans: list[dict]) -> str:
    """``text`` without the words of the spans."""
    raw = text.encode()
    _, s, e, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NOT_ALNUM)
    at, left = 0, []
    for x in spans:
        left.append(raw[at : s[x["start"]]])
        at = e[x["end"] - 1]
    return b"".join([*left, raw[at:]]).decode()


def _kept(batch: pa.RecordBatch, rows: list[dict], drop_share: float) -> pa.RecordBatch:
    """``batch`` by what was found in its rows: n_words and spans of each."""
    names = batch.schema.names
    texts = batch.column(names.index("text"))
    keep, new = [], texts.to_pylist()
    for i, row in enumerate(rows):
        spans = row["spans"]
        if spans and sum(x["end"] - x["start"] for x in spans) > drop_share * row["n_words"]:
            continue
        keep.append(i)
        if spans:
            new[i] = _without(new[i], spans)
    columns = [pa.array(new, texts.type) if n == "text" else batch.column(k) for k, n in enumerate(names)]
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema).take(pa.array(keep, pa.int64()))


def _cut(batches: Iterator[pa.RecordBatch], known: Windows, drop_share: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pair = pa.RecordBatch.from_arrays([pa.array(range(len(batch)), pa.int64()), batch.column(batch.schema.names.index("text"))], names=["doc_id", "text"])
        yield _kept(batch, [row for found in scan(iter([pair]), known) for row in found.to_pylist()], drop_share)


def _cut_found(batches: Iterator[pa.RecordBatch], drop_share: float) -> Iterator[pa.RecordBatch]:
    """As ``_cut``, of rows whose last two columns say what was found."""
    for batch in batches:
        n = len(batch.schema.names) - 2
        yield _kept(batch.select(list(range(n))), batch.select([n, n + 1]).rename_columns(["n_words", "spans"]).to_pylist(), drop_share)


def clean(docs: DataFrame, benchmark: DataFrame, drop_share: float = 0.5, width: int = WIDTH, part_words: int = 1_000_000) -> DataFrame:
    """``docs`` without benchmark text: the hit words are cut out of ``text``, and a document of
    which more than ``drop_share`` is hit goes.  Other rows and all columns stay as they are."""
    split = parts(benchmark, "item_id", "text", part_words)
    if len(split) == 1:
        get = shared(docs.sparkSession, _windows(split[0], width))
        return docs.mapInArrow(lambda batches: _cut(batches, get(), drop_share), docs.schema)
    rows = _numbered(docs)
    found = _scanned(rows, "__row", "text", split, width).select(F.col("doc_id").alias("__row"), F.col("n_words").alias("__n_words"), _merged("spans").alias("__spans"))
    joined = rows.join(found, "__row").select(*docs.columns, "__n_words", "__spans")
    return joined.mapInArrow(lambda batches: _cut_found(batches, drop_share), docs.schema)


def item_digest(items: list[str]) -> str:
    """The digest of a list of item ids, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
