"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised
residuals, asymmetric distance tables and exact reranking.  Nearness is the inner product.

Fitting: coarse centroids (about the root of the number of vectors, ``most_lists`` at most) and
the sub-space codebooks come from a sample of ``sample`` vectors at most (a documented bound),
by numpy k-means with a fixed seed.

Tuning: ``trials`` of the queries themselves meet every vector, exactly.  Lists are ranked by the
query's product with the centroid plus a share (``lean``) of the list's spread; the share and the
number of lists to probe are the least with which ``recall`` of those true neighbours lie in
probed lists, so queries unlike the table's vectors are reckoned with.

Searching: every vector is indexed under its nearest centroid with its codes and ``off``, the length
of what the codes leave out; a query goes to its probed lists.  In a list, tables of the query's
products with the codebooks score all codes.  The ``k + 1`` best are scored exactly, in double
precision, and so is every vector that may still beat them: whose rough score and ``margin`` times
the query's length times ``off`` reach the last of these.  A margin of 1 loses nothing (Cauchy and
Schwarz); the one used is the largest that a true neighbour of the trial queries asks for.

Equal vectors are one entry: of each, the k + 1 smallest ids are kept, which is all that a
result can show, so a vector that a third of all rows hold is one entry.  Lists and their
queries are dealt into blocks of ``block`` rows; every block of entries meets every block of
queries of its list, so no task holds more than two blocks.

Defined cases: null vectors, vectors with null or non-finite components, of another length
than the most common one, and zero vectors take no part, neither as queries nor as
candidates; ties go to the smaller id; rows that repeat an id and a vector count once; with
fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.store import cut
from quillon.llm.common import shared

BLOCK = 4096
EXACT = 1e-9  # of a vector's length: what rounding may hide
LEANS = (0.0, 0.125, 0.25, 0.5, 1.0)


@dataclass
class Index:
    """Coarse centroids, their lists' spread, codebooks (parts x codes x width), and what tuning
    chooses: lists to probe, the share of the spread in their order, the margin of rough scores."""

    centroids: np.ndarray
    spread: np.ndarray
    books: np.ndarray
    probes: int
    lean: float = 0.0
    margin: float = 1.0

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centroids)

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        rest = padded(x - self.centroids[cells], parts * width).reshape(len(x), parts, width)
        return np.stack([nearest(rest[:, p], self.books[p]) for p in range(parts)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        return np.einsum("qpw,pcw->qpc", padded(q, parts * width).reshape(len(q), parts, width), self.books)

    def decoded(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        rest = self.books[np.arange(parts)[None, :], codes].reshape(len(codes), parts * width)
        return self.centroids[cells] + rest[:, : self.centroids.shape[1]]

    def order(self, q: np.ndarray, lean: float) -> np.ndarray:
        reach = q @ self.centroids.T + lean * np.linalg.norm(q, axis=1)[:, None] * self.spread[None, :]
        return np.argsort(-reach, axis=1, kind="stable")

    def probed(self, q: np.ndarray) -> np.ndarray:
        return self.order(q, self.lean)[:, : self.probes]

    def tune(self, q: np.ndarray, query: np.ndarray, cells: np.ndarray, needed: np.ndarray, recall: float) -> None:
        """Choose lean, probes and margin by true neighbours: of ``q[query]``, in ``cells``, each asking for the margin ``needed``."""
        if not len(query):
            return
        tried = []
        for lean in LEANS:
            depth = np.sort(np.argsort(self.order(q, lean), axis=1)[query, cells])
            tried.append((int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) + 1, lean))
        self.probes, self.lean = min(tried)
        self.margin = float(min(1.0, max(0.0, needed.max())))


def padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(1) / 2
    return np.concatenate([(half - x[a : a + 4096] @ centroids.T).argmin(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def means(x: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means; an empty cluster starts again at a random vector."""
    centroids = x[random.choice(len(x), k, replace=len(x) < k)].astype(np.float64)
    for _ in range(rounds):
        own = nearest(x, centroids)
        n = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, x[:, d], k) for d in range(x.shape[1])], axis=1)
        centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[random.choice(len(x), k)])
    return centroids


def fitted(x: np.ndarray, total: int, most_lists: int = 1024, parts: int = 16, rounds: int = 8, seed: int = 5) -> Index:
    random = np.random.default_rng(seed)
    lists = int(min(most_lists, max(1, round(total**0.5)), len(x)))
    centroids = means(x, lists, rounds, random)
    parts = min(parts, x.shape[1])
    width = -(-x.shape[1] // parts)
    own = nearest(x, centroids)
    left = x - centroids[own]
    spread = np.sqrt(np.bincount(own, (left**2).sum(1), lists) / np.maximum(np.bincount(own, minlength=lists), 1))
    rest = padded(left, parts * width).reshape(len(x), parts, width)
    books = np.stack([means(rest[:, p], min(64, len(x)), rounds, random) for p in range(parts)])
    return Index(centroids, spread, books, lists)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = 0.97, sample: int = 20_000, trials: int = 256, block: int = BLOCK) -> DataFrame:
    """For each row that ``queries`` (on the id) picks, its k nearest others: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    raw = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v")))
    sizes = raw.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    # -0.0 and 0.0 are the same number; adding 0.0 makes them the same key.
    raw = raw.where(F.size("v") == sizes["d"]).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).withColumn("key", F.xxhash64("v"))
    smallest = Window.partitionBy("key", "v").orderBy("id")
    kept = raw.distinct().withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
    entries = cut(kept.groupBy("key", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("entry"), "ids", "v"), "ann-entries")
    total = entries.count()
    share = min(1.0, sample / total)
    chosen = entries.where(F.pmod(F.xxhash64("entry"), F.lit(1 << 30)) < share * (1 << 30)).select("entry", "v").toArrow().sort_by("entry")
    x = _matrix(chosen["v"].combine_chunks()) if chosen.num_rows else _matrix(entries.limit(1).select("v").toArrow()["v"].combine_chunks())
    built = fitted(x, total)
    get = shared(spark, built)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            v = _matrix(batch.column(1))
            cells = own.cells(v)
            codes = own.codes(v, cells)
            off = np.linalg.norm(v - own.decoded(cells, codes), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)], names=["cell", "entry", "v", "codes", "off"])

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (q, q_entry) = get(), asked_some.value
        size = np.linalg.norm(q, axis=1)
        for batch in batches:
            v, ids = _matrix(batch.column(2)), batch.column(1).to_numpy()
            score = np.where(q_entry[:, None] == ids[None, :], -np.inf, q @ v.T)
            n = min(k, score.shape[1])
            at = np.argpartition(-score, n - 1, axis=1)[:, :n].reshape(-1) if n else np.zeros(0, np.int64)
            query = np.repeat(np.arange(len(q)), n)
            cells, off, exact = batch.column(0).to_numpy()[at], batch.column(4).to_numpy()[at], score[query, at]
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(ids), -1)[at]
            rough = (own.decoded(cells, codes) * q[query]).sum(1)
            loose = off > EXACT * np.linalg.norm(v[at], axis=1)
            need = np.where(loose, (exact - rough) / np.where(loose, size[query] * off, 1.0), 0.0)
            good = np.isfinite(exact)
            columns = [query.astype(np.int32), ids[at], exact, cells, need]
            yield pa.RecordBatch.from_arrays([pa.array(c[good]) for c in columns], names=["query", "entry", "score", "cell", "need"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            cells = own.probed(_matrix(batch.column(1)))
            rows = pa.array(np.repeat(np.arange(len(batch)), cells.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(cells.reshape(-1).astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows)], names=["cell", "entry", "v"])

    lists = cut(entries.select("entry", "v").mapInArrow(index, "cell int, entry long, v array<double>, codes binary, off double"), "ann-lists")
    asked = raw.where(queries(F.col("id")) if callable(queries) else queries).select("id", "key", "v").distinct()
    asked_entries = entries.select("entry", "v", F.xxhash64("v").alias("key"))
    of_query = cut(asked.join(asked_entries, ["key", "v"]).select("id", "entry"), "ann-queries")
    every_asked = cut(of_query.select("entry").distinct().join(entries.select("entry", "v"), "entry"), "ann-asked")
    some = every_asked.orderBy(F.xxhash64("entry", F.lit("trial")), "entry").limit(trials).toArrow()
    if not some.num_rows:
        return spark.createDataFrame([], empty)
    asked_some = spark.sparkContext.broadcast((_matrix(some["v"].combine_chunks()), some["entry"].to_numpy()))
    closest = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    true = lists.mapInArrow(truth, "query int, entry long, score double, cell int, need double").withColumn("r", F.row_number().over(closest)).where(F.col("r") <= k).toArrow()
    built.tune(asked_some.value[0], true["query"].to_numpy(), true["cell"].to_numpy(), true["need"].to_numpy(), recall)
    get = shared(spark, built)
    routed = cut(every_asked.mapInArrow(route, "cell int, entry long, v array<double>"), "ann-routed")
    n_lists = lists.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    n_asked = routed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("qb"))
    grid = F.broadcast(n_lists.join(n_asked, "cell"))  # a row a list: most_lists at most
    left = lists.join(grid, "cell").select("cell", F.pmod(F.xxhash64("entry"), F.col("nb")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("j"), "entry", "v", "codes", "off")
    right = routed.join(grid, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), F.pmod(F.xxhash64("entry"), F.col("qb")).cast("int").alias("j"), "entry", "v")

    def meet(entry: pa.Table, query: pa.Table) -> pa.Table:
        out, own = [], get()
        if entry.num_rows and query.num_rows:
            at, ids = _matrix(entry["v"].combine_chunks()), entry["entry"].to_numpy()
            codes = np.frombuffer(b"".join(entry["codes"].to_pylist()), np.uint8).reshape(len(ids), -1).astype(np.int64)
            cell, off = entry["cell"][0].as_py(), entry["off"].to_numpy()
            reach = own.margin * off + 2 * EXACT * np.linalg.norm(at, axis=1)
            asked_v, asked_id = _matrix(query["v"].combine_chunks()), query["entry"].to_numpy()
            place = np.arange(codes.shape[1])[None, :]
            for a in range(0, len(asked_v), 64):
                q = asked_v[a : a + 64]
                tables, base = own.tables(q), q @ own.centroids[cell]
                for r in range(len(q)):
                    some = np.arange(len(ids))
                    if len(ids) > k + 1:
                        rough = tables[r][place, codes].sum(1) + base[r]
                        first = np.argpartition(-rough, k)[: k + 1]
                        some = np.flatnonzero(rough + np.linalg.norm(q[r]) * reach >= (at[first] @ q[r]).min())
                    exact = np.array([float(np.dot(at[s], q[r])) for s in some]) if len(some) < 8 else at[some] @ q[r]
                    top = np.lexsort((ids[some], -exact))[: k + 1]
                    out.append((np.full(len(top), asked_id[a + r]), ids[some][top], exact[top]))
        columns = list(zip(*out, strict=True)) if out else []
        return pa.table({"query": np.concatenate(columns[0]) if columns else np.zeros(0, np.int64), "entry": np.concatenate(columns[1]) if columns else np.zeros(0, np.int64), "score": np.concatenate(columns[2]) if columns else np.zeros(0)})

    found = left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInArrow(meet, "query long, entry long, score double")
    near = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    best = cut(found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).drop("r"), "ann-best")
    # The score as every reader computes it: components added from first to last.
    product = F.aggregate(F.zip_with("p", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    vec = entries.select("entry", "ids", "v")
    scored = best.join(vec.select("entry", "ids", F.col("v").alias("p")), "entry").join(vec.select(F.col("entry").alias("query"), F.col("v").alias("q")), "query").select("query", F.explode("ids").alias("vec_id"), product.alias("score"))
    per_entry = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    short = scored.withColumn("r", F.row_number().over(per_entry)).where(F.col("r") <= k + 1).drop("r")
    lists_of = cut(short.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near")), "ann-near")
    each = of_query.join(lists_of, of_query["entry"] == lists_of["query"]).select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("near"))
    return each.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
