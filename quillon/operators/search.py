"""Nearest neighbours and what is built on them: batches, hybrids, groups, recommendation,
prefetch, matrices, paging.

A collection is a DataFrame with a key and a vector column; results are exact.  Searching is
always "score, then top k": one query keeps a k-row heap a partition (TakeOrderedAndProject).
Many queries are all pairs by nature: rows and queries are dealt into blocks, every block of rows
meets every block of queries as one matrix product, and k rows a query leave a block.  A task holds
two blocks of ``BLOCK`` rows at most, and nothing passes through the driver.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.vectors import matrix_score, search_score

BLOCK, LEAST_BLOCK = 32_768, 2_048


def ranked(df: DataFrame, k: int, score: str = "score", key: str = "vec_id", by: tuple[str, ...] = (), as_rank: str = "rank", then: tuple[str, ...] = ()) -> DataFrame:
    """The k best rows (of each value of ``by``) with their rank; ties go to the smaller key, then to the smaller ``then``."""
    order = (F.desc(score), key, *then)
    best = Window.partitionBy(*by).orderBy(*order)
    if not by:
        return df.orderBy(*order).limit(k).withColumn(as_rank, F.row_number().over(best))
    return df.withColumn(as_rank, F.row_number().over(best)).where(F.col(as_rank) <= k)


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def knn(collection: DataFrame, query: list[float], k: int, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k nearest to one vector.  ``where`` filters before ranking, so no result is lost to it."""
    rows = collection.where(where) if where is not None else collection
    return ranked(rows.withColumn("score", F.round(search_score(metric, F.col(vector), literal(query)), 6)), k, key=key)


def rounded(x: np.ndarray) -> np.ndarray:
    """To six places as Spark does it: the shortest decimal form, halves away from zero."""
    y = np.abs(x) * 1e6
    out = np.floor(y + 0.5) / 1e6
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(abs(float(x[i])))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return np.copysign(out, x)


def _doubles(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products from the first component on, as the kernels add them."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[..., d]
    return out


def _squares_in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _in_order(a - b, a - b)


def _scored(metric: str, exact: bool, rows: np.ndarray, norms: np.ndarray, q: np.ndarray, q_norms: np.ndarray) -> np.ndarray:
    """Scores of all rows with all of ``q`` by a matrix product, or, exactly, of rows with one query."""
    if metric == "euclidean":
        if exact:
            return 1 / (1 + np.sqrt(_squares_in_order(rows, q)))
        return 1 / (1 + np.sqrt(np.maximum(0.0, (q_norms**2)[:, None] + (norms**2)[None, :] - 2 * (q @ rows.T))))
    dot = _in_order(rows, q) if exact else q @ rows.T
    if metric == "dot":
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-dot))
    n = norms * q_norms if exact else q_norms[:, None] * norms[None, :]
    return np.where(n == 0, 0.0, dot / np.where(n == 0, 1.0, n))


def _ordinary(v: str, size: int | None) -> Column:
    """Of that length, every component a number of a size whose square is one as well."""
    return F.coalesce((F.size(v) == F.lit(size)) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < 1e100)), F.lit(False))


def batch_knn(collection: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query: str = "query", other: bool = True, score: Column | None = None) -> DataFrame:
    """The k nearest to each row of ``queries`` (query_id, query); ``other`` leaves out the row with the query's own id.

    Vectors that hold nulls or no finite numbers, or are of another length than the most, are scored
    pair by pair, as all are by an expression ``score`` of one's own."""
    differ = F.col(query_id) != F.col(key) if other else F.lit(True)

    def pairwise(rows: DataFrame, asked: DataFrame) -> DataFrame:
        value = score if score is not None else search_score(metric, F.col(vector), F.col(query))
        return rows.join(asked, differ).withColumn("score", F.round(value, 6)).drop(vector, query)

    if score is not None:
        return ranked(pairwise(collection, queries), k, key=key, by=(query_id,))
    common = collection.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    size = common["d"] if common else None
    good, asked_good = _ordinary(vector, size) & F.col(key).isNotNull(), _ordinary(query, size) & F.col(query_id).isNotNull()
    n, odd = collection.agg(F.count_if(good), F.count_if(~good)).first()
    n_asked, odd_asked = queries.agg(F.count_if(asked_good), F.count_if(~asked_good)).first()
    parts = [_by_blocks(collection.where(good), queries.where(asked_good), n, n_asked, k, metric, key, vector, query_id, query, other)]
    if odd:
        parts.append(pairwise(collection.where(~good), queries))
    if odd_asked:
        parts.append(pairwise(collection.where(good), queries.where(~asked_good)))
    return ranked(reduce(DataFrame.union, parts), k, key=key, by=(query_id,))


def _by_blocks(rows: DataFrame, asked: DataFrame, n: int, n_asked: int, k: int, metric: str, key: str, vector: str, query_id: str, query: str, other: bool) -> DataFrame:
    """Of each block of rows the k best for each query, ties to the smaller key: the columns of both sides without vectors, and score."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = lambda rows: max(-(-rows // BLOCK), min(cores, -(-rows // LEAST_BLOCK)), 1)
    nb, qb = blocks(n), -(-n_asked // BLOCK) or 1
    c_names, q_names = [c for c in rows.columns if c != vector], [c for c in asked.columns if c != query]
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(c_names)]
    theirs = [F.col(c).alias(f"q{i}") for i, c in enumerate(q_names)]
    at, to = f"c{c_names.index(key)}", f"q{q_names.index(query_id)}"
    deal = lambda c, m: F.pmod(F.xxhash64(c, F.lit("block")), F.lit(m)).cast("int")
    left = rows.select(*own, F.col(vector).alias("v"), deal(key, nb).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("j"))
    right = asked.select(*theirs, F.col(query).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("i"), deal(query_id, qb).alias("j"))
    schema = ", ".join(f"{name} {kind}" for df in (left.drop("v", "i", "j"), right.drop("w", "i", "j")) for name, kind in df.dtypes) + ", score double"

    names = [f"c{i}" for i in range(len(own))] + [f"q{i}" for i in range(len(theirs))] + ["score"]

    def meet(row: pa.Table, ask: pa.Table) -> pa.Table:
        took, of, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if row.num_rows and ask.num_rows:
            row = row.sort_by(at)  # so an earlier row has the smaller key
            x, q = _doubles(row["v"]), _doubles(ask["w"])
            norms, q_norms = np.sqrt(_in_order(x, x)), np.sqrt(_in_order(q, q))
            keys, ids = row[at].to_numpy(), ask[to].to_numpy()
            low, high = np.searchsorted(keys, ids, "left"), np.searchsorted(keys, ids, "right")
            # A rounding to six places, and what a matrix product may be off by.
            near = 2e-6 + {"cosine": 0.0, "dot": 1e-13 * q_norms * norms.max(), "euclidean": 1e-6 * (q_norms + norms.max())}[metric] * np.ones(len(q))
            step = max(1, (1 << 22) // len(x))
            for a in range(0, len(q), step):
                s = _scored(metric, False, x, norms, q[a : a + step], q_norms[a : a + step])
                if other:
                    for r in range(len(s)):
                        s[r, low[a + r] : high[a + r]] = -np.inf
                # Scores within a rounding of the k-th best are told apart exactly.
                least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(s), -np.inf)
                for r in range(len(s)):
                    some = np.flatnonzero((s[r] >= least[r] - near[a + r]) & (s[r] > -np.inf))
                    value = rounded(_scored(metric, True, x[some], norms[some], q[a + r], q_norms[a + r]))
                    best = np.argsort(-value, kind="stable")[:k]
                    took.append(some[best])
                    of.append(np.full(len(best), a + r))
                    scores.append(value[best])
        return pa.table(row.drop_columns(["v", "i", "j"]).take(pa.array(np.concatenate(took))).columns + ask.drop_columns(["w", "i", "j"]).take(pa.array(np.concatenate(of))).columns + [pa.array(np.concatenate(scores))], names=names)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, schema)
    return found.toDF(*c_names, *q_names, "score")


def over(results: DataFrame, least: float, score: str = "score") -> DataFrame:
    """The score threshold, after top k as everywhere in this family."""
    return results.where(F.col(score) >= least)


# Hybrid search: two ranked lists (key, score, rank), fused.


def both_lists(dense: DataFrame, sparse: DataFrame, key: str = "vec_id") -> DataFrame:
    d = dense.select(F.col(key), F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    s = sparse.select(F.col(key), F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    return d.join(s, key, "full_outer")


def additive_rrf(lists: DataFrame, alpha: float = 0.7, base: int = 60) -> DataFrame:
    """Each list adds its weight times (score + 1 / (base + rank)): raw scores count as well."""
    side = lambda score, rank, w: F.coalesce(w * F.col(score) + w / (base + F.col(rank)), F.lit(0.0))
    return lists.withColumn("score", side("dense_score", "dense_rank", alpha) + side("sparse_score", "sparse_rank", 1 - alpha))


def weighted(lists: DataFrame, alpha: float = 0.7) -> DataFrame:
    return lists.withColumn("score", alpha * F.coalesce("dense_score", F.lit(0.0)) + (1 - alpha) * F.coalesce("sparse_score", F.lit(0.0)))


def alpha_blend(lists: DataFrame, alpha: float = 0.7) -> DataFrame:
    """Each list over its largest score, if that is positive, then weighted."""
    most = lists.agg(F.max("dense_score").alias("__d"), F.max("sparse_score").alias("__s"))
    scaled = lists.join(F.broadcast(most))
    for name, top in (("dense_score", "__d"), ("sparse_score", "__s")):
        scaled = scaled.withColumn(name, F.when(F.col(top) > 0, F.col(name) / F.nullif(F.col(top), F.lit(0.0))).otherwise(F.col(name)))
    return weighted(scaled.drop("__d", "__s"), alpha)


FUSIONS = {"rrf": additive_rrf, "weighted": weighted, "alpha": alpha_blend}


def hybrid(dense: DataFrame, sparse: DataFrame, k: int = 10, alpha: float = 0.7, fusion: str = "rrf", key: str = "vec_id") -> DataFrame:
    fused = FUSIONS[fusion](both_lists(dense, sparse, key), alpha)
    return ranked(fused.withColumn("score", F.round("score", 6)), k, key=key)


def two_stage(first: DataFrame, collection: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rerank a first stage's ids by dense cosine."""
    return knn(collection.join(first.select(key), key, "left_semi"), query, k, key=key, vector=vector)


def boosted(results: DataFrame, order: list[str], name: str = "collection", step: float = 0.1, per: int = 5, k: int = 20, key: str = "vec_id") -> DataFrame:
    """Several collections: ``per`` of each, scores raised by the collections' order, the k best."""
    boost = F.create_map(*(x for i, c in enumerate(order) for x in (F.lit(c), F.lit(1 + step * (len(order) - i)))))
    own = ranked(results, per, key=key, by=(name,), as_rank="own_rank").drop("own_rank")
    return ranked(own.withColumn("score", F.round(F.col("score") * F.coalesce(F.try_element_at(boost, F.col(name)), F.lit(1.0)), 6)), k, key=key)


# Query vectors made of stored ones.


def mean_vector(collection: DataFrame, ids: list, key: str = "vec_id", vector: str = "embedding") -> list[float] | None:
    """The mean of the stored vectors of ``ids``: one row to the driver."""
    parts = collection.where(F.col(key).isin(ids)).select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in parts] or None


def recommend_vector(collection: DataFrame, positive: list, negative: list | None = None, strategy: str = "average", key: str = "vec_id", vector: str = "embedding") -> list[float] | None:
    """``average``: mean of the positives (negatives are not used); ``best``: the first positive;
    ``query``: mean of the positives less the negatives' sum over the number of positives."""
    if strategy == "best":
        return mean_vector(collection, positive[:1], key, vector)
    mean = mean_vector(collection, positive, key, vector)
    if strategy == "query" and negative and mean:
        low = mean_vector(collection, negative, key, vector)
        if low:
            return [a - b * len(negative) / len(positive) for a, b in zip(mean, low, strict=True)]
    return mean


def paged(results: DataFrame, offset: int, limit: int) -> DataFrame:
    return results.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def points_search(collection: DataFrame, query: list[float], limit: int, offset: int = 0, least: float | None = None, where: Column | None = None, compat: bool = False, **more) -> DataFrame:
    """``compat`` pages first and filters after, so it may return fewer; the default filters first."""
    if compat:
        page = paged(knn(collection, query, limit + offset, **more), offset, limit)
        page = page.where(F.col("score") >= least) if least is not None else page
        return page.where(where) if where is not None else page
    found = knn(collection, query, limit + offset, where=where, **more)
    found = found.where(F.col("score") >= least) if least is not None else found
    return paged(found, offset, limit)


def prefetch(collection: DataFrame, stages: list[dict], key: str = "vec_id") -> DataFrame:
    """Candidate ids of nested stages: {query, limit, least?, where?, prefetch?}; nested ones are
    intersected, sibling ones united."""
    parts = []
    for stage in stages:
        found = knn(collection, stage["query"], stage.get("limit", 100), key=key)
        if stage.get("least") is not None:
            found = found.where(F.col("score") >= stage["least"])
        if stage.get("where") is not None:
            found = found.where(stage["where"])
        if stage.get("prefetch"):
            found = found.join(prefetch(collection, stage["prefetch"], key), key, "left_semi")
        parts.append(found.select(key))
    return reduce(DataFrame.union, parts).distinct()


def groups(results: DataFrame, by: Column, groups: int, size: int, key: str = "vec_id") -> DataFrame:
    """``size`` best hits of the ``groups`` groups with the best hits; a missing value is ``__null__``."""
    named = results.withColumn("group_id", F.coalesce(by.cast("string"), F.lit("__null__")))
    hits = ranked(named.drop("rank"), size, key=key, by=("group_id",), as_rank="hit_rank")
    best = hits.where("hit_rank = 1").select("group_id", F.col("score").alias("best"), F.col(key).alias("first"))
    top = best.orderBy(F.desc("best"), "first").limit(groups).withColumn("group_rank", F.row_number().over(Window.orderBy(F.desc("best"), "first")))
    return hits.join(F.broadcast(top.select("group_id", "group_rank")), "group_id")


def with_lookup(grouped: DataFrame, lookup: DataFrame, on: Column) -> DataFrame:
    return grouped.join(lookup, on, "left")


def matrix_pairs(collection: DataFrame, sample: int = 10, limit: int = 100, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Scores of all pairs among the first ``sample`` rows, ``limit`` pairs at most (both are the feature)."""
    first = collection.orderBy(key).limit(sample).select(key, vector).withColumn("rn", F.row_number().over(Window.orderBy(key)))
    a, b = first.toDF("a", "va", "ra"), first.toDF("b", "vb", "rb")
    pairs = a.join(b, F.col("ra") < F.col("rb")).withColumn("score", F.round(matrix_score(metric, F.col("va"), F.col("vb")), 6))
    return pairs.orderBy("ra", "rb").limit(limit).select("a", "b", "score", "ra")


def matrix_offsets(pairs: DataFrame) -> DataFrame:
    """The same as rows of a compressed matrix: each first id with its columns, scores and offset."""
    rows = pairs.groupBy("a", "ra").agg(F.array_sort(F.collect_list(F.struct("b", "score"))).alias("cells"), F.count("*").alias("n"))
    before = Window.orderBy("ra").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("a", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.col("cells.b").alias("columns"), F.col("cells.score").alias("scores"))


def scroll(collection: DataFrame, after: int | None, limit: int, key: str = "vec_id", compat: bool = False) -> DataFrame:
    """A page in key order; ``compat`` starts at the offset id itself, so pages overlap by a row."""
    rows = collection if after is None else collection.where(F.col(key) >= after if compat else F.col(key) > after)
    return rows.orderBy(key).limit(limit)


def count(collection: DataFrame, where: Column | None = None) -> DataFrame:
    return (collection.where(where) if where is not None else collection).agg(F.count("*").alias("count"))


def facet(collection: DataFrame, by: Column, limit: int = 10) -> DataFrame:
    """Values and how often they occur, most frequent first."""
    return collection.groupBy(by.alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(limit)


