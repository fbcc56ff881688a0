"""Similarity graphs: nodes and edges as DataFrames, found by search, walked by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.store import cut
from quillon.operators.search import batch_knn


def similar_edges(collection: DataFrame, queries: DataFrame, least: float = 0.7, most: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Edges from each query to its nearest others of score ``least`` or more."""
    found = batch_knn(collection, queries, min(2 * most, 20), key=key, vector=vector)
    best = Window.partitionBy("query_id").orderBy("rank")
    kept = found.where(F.col("score") >= least).withColumn("n", F.row_number().over(best)).where(F.col("n") <= most)
    return kept.select(F.col("query_id").alias("source"), F.col(key).alias("target"), F.lit("SIMILAR_TO").alias("type"), F.col("score").alias("weight"))


def reference_edges(payloads: DataFrame, field: str, kind: str, key: str = "id", payload: str = "payload", path: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """Edges of weight 1 to what a payload's array or string names, by file path or id; and the
    nodes that had to be made for names nothing has."""
    raw = F.get_json_object(payload, f"$.{field}")
    names = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    named = payloads.select(F.col(key).alias("source"), F.explode(F.filter(names, lambda n: n.isNotNull())).alias("name"))
    known = payloads.select(F.col(key).cast("string").alias("target"), F.get_json_object(payload, f"$.{path}").alias("name")).where("name is not null")
    edges = named.join(known, "name", "left").select("source", F.coalesce("target", "name").alias("target"), F.lit(kind).alias("type"), F.lit(1.0).alias("weight"), F.col("target").isNull().alias("made"))
    return edges.drop("made"), edges.where("made").select(F.col("target").alias("id")).distinct()


def add_edges(nodes: DataFrame, edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges whose ends exist, the later of equal ids."""
    ok = more.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    both = edges.withColumn("__new", F.lit(0)).unionByName(ok.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy("source", "target", "type").orderBy(F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__new")


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes and the edges at them."""
    left = edges.join(ids.select(F.col("id").alias("source")), "source", "left_anti").join(ids.select(F.col("id").alias("target")), "target", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left


def neighbours(edges: DataFrame, node, kind: str | None = None) -> DataFrame:
    rows = edges.where(F.col("source") == node)
    return (rows.where(F.col("type") == kind) if kind else rows).select(F.col("target").alias("node"), "type", "weight")


def related(edges: DataFrame, start, hops: int, kind: str | None = None) -> DataFrame:
    """Nodes within ``hops`` of a start: hop, and the product of the weights along the first path
    found (of equal hops the heaviest), one join a hop."""
    edges = edges.where(F.col("type") == kind) if kind else edges
    seen = edges.sparkSession.range(1).select(F.lit(start).cast(dict(edges.dtypes)["source"]).alias("node"), F.lit(0).alias("hop"), F.lit(1.0).alias("weight"))
    front = seen
    for hop in range(1, hops + 1):
        step = front.join(edges.select(F.col("source").alias("node"), "target", F.col("weight").alias("w")), "node").groupBy(F.col("target").alias("node")).agg(F.max(F.col("weight") * F.col("w")).alias("weight"))
        front = cut(step.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hop"), "weight"), "graph-front")
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def shortest_path_length(edges: DataFrame, start, end, most: int = 20) -> int | None:
    """Hops of the shortest path, or None; stops at the hop that reaches the end."""
    kind = dict(edges.dtypes)["source"]
    seen = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"))
    front = seen
    if start == end:
        return 0
    for hop in range(1, most + 1):
        front = cut(front.join(edges.select(F.col("source").alias("node"), "target"), "node").select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti"), "graph-front")
        if front.where(F.col("node") == F.lit(end)).take(1):
            return hop
        if not front.take(1):
            return None
        seen = seen.union(front)
    return None


def connected(edges: DataFrame, hot: int = 10_000) -> DataFrame:
    """node and component (its smallest node) over undirected edges: the smallest label spreads,
    and labels jump to their own label, until nothing changes.  Labels of more than ``hot`` nodes,
    so one in ``hot`` nodes at most, are broadcast."""
    both = edges.select("source", "target").union(edges.select("target", "source")).distinct()
    both = cut(both, "graph-edges")
    labels = cut(both.groupBy(F.col("source").alias("node")).agg(F.min("target").alias("m")).select("node", F.least("node", "m").alias("component")), "graph-labels")
    while True:  # labels only ever fall, so this ends
        spread = both.join(labels, both["target"] == labels["node"]).groupBy("source").agg(F.min("component").alias("m"))
        nearer = cut(labels.join(spread, labels["node"] == spread["source"]).select("node", F.least("component", "m").alias("c"), F.col("component").alias("old")), "graph-nearer")
        jump = nearer.select(F.col("node").alias("at"), F.col("c").alias("up"))
        # Most nodes come to share a few labels: these are joined without dealing their rows to one task.
        many = F.broadcast(nearer.groupBy("c").count().where(F.col("count") > hot).join(jump, F.col("c") == F.col("at")).select("c", "up"))
        few = nearer.join(many, "c", "left_anti").join(jump, F.col("c") == F.col("at")).select("node", "c", "up", "old")
        both_ways = few.union(nearer.join(many, "c").select("node", "c", "up", "old"))
        fresh = cut(both_ways.select("node", F.least("c", "up").alias("component"), "old"), "graph-labels")
        labels = fresh.select("node", "component")
        if not fresh.where("component <> old").take(1):
            return labels
