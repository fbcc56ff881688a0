"""Values worked out by hand for what has no SQL, and for rules that are easily got wrong."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import predicates, sparse, vectors
from quillon.functions import text as tx
from quillon.operators import dml, embed, evaluate, files, graph, quantize, rerank, search
from quillon.sources import readers
from quillon.streaming import jobs
from tests.conftest import SMALL


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scores(spark):
    a, b = search.literal([3, 4]), search.literal([4, 3])
    assert value(spark, vectors.dot(a, b)) == 24
    assert value(spark, vectors.cosine(a, b)) == pytest.approx(0.96)
    assert value(spark, vectors.search_score("euclidean", a, b)) == pytest.approx(0.414214, abs=1e-6)
    assert value(spark, vectors.search_score("dot", a, b)) == pytest.approx(1.0)
    zero = search.literal([0, 0])
    assert value(spark, vectors.cosine(a, zero)) == 0
    assert value(spark, vectors.normalize(zero)) == [0, 0]


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_batches_by_blocks(spark, metric, monkeypatch):
    """Blocks give what scoring pair by pair gives, with ties, odd vectors, repeated keys, other columns and no rows."""
    monkeypatch.setattr(search, "BLOCK", 16)
    monkeypatch.setattr(search, "LEAST_BLOCK", 4)
    vectors_ = [[float(i % 7), 1.0, float(i % 3) / 3] for i in range(60)] + [None, [1.0, None, 2.0], [1.0], [float("nan"), 1.0, 1.0], [0.0, 0.0, 0.0], [1e200, 1.0, 1.0], [3.0, 1.0, 0.0]]
    emb = spark.createDataFrame([(None if i == 50 else 40 if i == 41 else i, v, f"l{i % 5}") for i, v in enumerate(vectors_)], "vec_id long, embedding array<double>, label string")
    asked = emb.where("vec_id % 3 = 0 or vec_id > 58").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))
    own = vectors.search_score(metric, F.col("embedding"), F.col("query"))
    for other in (True, False):
        got, want = (search.batch_knn(emb, asked, 4, metric, other=other, score=s) for s in (None, own))
        assert got.columns == want.columns
        by = lambda df: sorted(str((r["query_id"], r["rank"], r["vec_id"], r["score"])) for r in df.collect())  # noqa: B023, E731
        assert by(got) == by(want)
    assert search.batch_knn(emb.limit(0), asked, 4, metric).count() == 0 and search.batch_knn(emb, asked.limit(0), 4, metric).count() == 0


def test_batches_do_not_score_pair_by_pair(spark):
    """4,000 rows against themselves: pair by pair, by expressions, this took minutes (304 s for 2,000 rows in round 2)."""
    import time

    emb = spark.range(4000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sin(F.col("id") * (i + 1))).alias("embedding"))
    start = time.time()
    assert graph.similar_edges(emb, emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), -1.0).count() == 40_000
    assert time.time() - start < 60


def test_label_curves(spark):
    results = spark.createDataFrame([(1, 2, 1, "a", "a"), (1, 3, 2, "b", "a"), (5, 2, 1, "a", "c"), (6, 2, 1, "a", None)], "query_id int, vec_id int, rank int, label string, query_label string")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (4, "a"), (3, "b"), (5, "c"), (6, None)], "vec_id int, label string")
    truth = spark.createDataFrame([(1, 2), (1, 4)], "query_id int, vec_id int")
    columns = ["query_id", "rank", "hit", "hits", "precision_at_k", "curve", "recall"]
    got, want = evaluate.label_curves(results, rows, key="vec_id"), evaluate.curves(results, truth, key="vec_id")
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def lists(spark):
    dense = spark.createDataFrame([("doc1", 0.9, 1), ("doc2", 0.8, 2), ("doc3", 0.7, 3)], "vec_id string, score double, rank int")
    thin = spark.createDataFrame([("doc2", 0.85, 1), ("doc1", 0.75, 2), ("doc4", 0.65, 3)], "vec_id string, score double, rank int")
    return dense, thin


@pytest.mark.parametrize(("fusion", "want"), [("rrf", [0.871314, 0.831208, 0.501111, 0.199762]), ("weighted", [0.855, 0.815, 0.49, 0.195]), ("alpha", [0.964706, 0.922222, 0.544444, 0.229412])])
def test_fusion(spark, fusion, want):
    got = {r["vec_id"]: r["score"] for r in search.hybrid(*lists(spark), 10, 0.7, fusion).collect()}
    assert [got[f"doc{i}"] for i in (1, 2, 3, 4)] == pytest.approx(want, abs=1e-6)


def test_codes(spark):
    v = search.literal([0, 0.5, 1])
    q = value(spark, quantize.sq8(v))
    assert q["codes"] == [0, 127, 255]
    assert value(spark, quantize.sq8_back(quantize.sq8(v)))[1] == pytest.approx(0.498039, abs=1e-6)
    assert value(spark, quantize.binary(v)) == [0, 0, 1]
    assert value(spark, quantize.global_codes(v, 0.0, 1.0, 8)) == [0, 128, 255]


def test_sparse(spark):
    s = sparse.from_dense(search.literal([1, 0, 2, 0]))
    assert value(spark, s).asDict() == {"indices": [0, 2], "values": [1.0, 2.0]}
    assert value(spark, sparse.to_dense(s, 3)) == [1.0, 0.0, 2.0]
    one, two = sparse.from_dense(search.literal([1, 1, 0])), sparse.from_dense(search.literal([1, 1, 1]))
    assert value(spark, sparse.cosine(one, two)) == pytest.approx(0.816497, abs=1e-6)
    bad = F.struct(F.array(F.lit(2), F.lit(1)).alias("indices"), F.array(F.lit(1.0), F.lit(1.0)).alias("values"))
    assert value(spark, sparse.valid(s)) and not value(spark, sparse.valid(bad))


PAYLOAD = '{"price": 50, "category": "electronics", "in_stock": true, "tags": ["a", "b", "c"], "location": {"lat": 40.7128, "lon": -74.006}, "none": null, "code": "1"}'


@pytest.mark.parametrize(
    ("tree", "want"),
    [
        ({"must": [{"key": "price", "range": {"gte": 30, "lte": 70}}, {"key": "in_stock", "match": {"value": True}}, {"key": "category", "match": {"value": "electronics"}}]}, True),
        ({"must": [{"key": "price", "range": {"gte": 30}}], "must_not": [{"key": "category", "match": {"value": "electronics"}}]}, False),
        ({"must": [{"key": "location", "geo_box": {"min_lat": 40, "max_lat": 41, "min_lon": -75, "max_lon": -73}}]}, True),
        ({"must": [{"key": "tags", "values_count": {"gte": 3}}]}, True),
        ({"must": [{"key": "tags", "values_count": {"gte": 4}}]}, False),
        ({"must": [{"key": "absent", "match": {"value": 1}}]}, False),
        ({"must_not": [{"key": "absent", "match": {"value": 1}}]}, True),
        ({"must": [{"key": "none", "match": {"any": True}}]}, False),
        ({"must": [{"key": "code", "match": {"value": 1}}]}, False),
        ({"should": [{"key": "price", "match": {"value": 1}}, {"must": [{"key": "price", "match": {"value": 50}}]}]}, True),
    ],
)
def test_filters(spark, tree, want):
    assert spark.createDataFrame([(PAYLOAD,)], "p string").select(predicates.compiled(F.col("p"), tree).alias("v")).first()["v"] is want


def test_text(spark):
    assert value(spark, tx.sentence_quality(F.lit("It provides nine useful words in this short line."))) == pytest.approx(1.0)
    a, b = tx.word_set(F.lit("a b c")), tx.word_set(F.lit("b c d"))
    assert value(spark, tx.jaccard(a, b)) == 0.5
    empty = tx.word_set(F.lit(""))
    assert value(spark, tx.jaccard(empty, empty)) == 0 and value(spark, tx.jaccard(empty, empty, 1.0)) == 1
    assert value(spark, tx.normalized(F.lit("﻿a \r\n\r\n\r\n\r\nb​"))) == "a\n\nb"
    assert value(spark, tx.content_type(F.lit("# a\n- b\n- c\n"))) == "markdown"


def test_chunks_and_back():
    text = "".join(f"Satz {i} über etwas. " for i in range(400))
    parts = tx.chunk(text, 512, 64)
    assert all(len(c.encode()) <= 512 for _, c in parts)
    assert parts[0][1].startswith("Satz 0") and parts[-1][1].endswith("etwas.")
    assert files.joined_text(["abcd", "cdef"]) == "abcdef"
    assert tx.chunk("", 10, 2) == [] and tx.chunk("x" * 25, 10, 2)[0] == (0, "x" * 10)


def test_evaluation(spark):
    results = spark.createDataFrame([(1, "doc1", 1), (1, "doc2", 2), (1, "doc3", 3)], "query_id int, doc_id string, rank int")
    truth = spark.createDataFrame([(1, "doc1"), (1, "doc3")], "query_id int, doc_id string")
    curve = evaluate.curves(results, truth)
    rows = curve.orderBy("rank").collect()
    assert [r["curve"] for r in rows] == pytest.approx([1, 1, 2 / 3])
    assert [r["precision_at_k"] for r in rows] == pytest.approx([1, 0.5, 2 / 3])
    assert [r["recall"] for r in rows] == pytest.approx([0.5, 0.5, 1])
    own = evaluate.by_query(curve).first()
    assert own["ap"] == pytest.approx(0.833333, abs=1e-6) and own["rr"] == 1


def test_idf(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "beta delta"), (4, "beta beta")], "id int, text string")
    model = embed.BM25.fit(docs, "id", "text")
    idf = {r["term"]: r["idf"] for r in model.vocabulary.collect()}
    assert idf["alpha"] == pytest.approx(1.203973, abs=1e-6)
    assert model.weights(docs, "id", "text").where("id = 1 and term = 'alpha'").first()["weight"] == pytest.approx(1.203973, abs=1e-6)


def test_mmr_and_dedup(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, "a b c d"), (1, 2, 0.89, "a b c d"), (1, 3, 0.5, "x y z")], "query_id int, doc_id int, score double, content string")
    assert [r["doc_id"] for r in rerank.mmr(rows, 2).orderBy("position").collect()] == [1, 3]
    assert sorted(r["doc_id"] for r in rerank.distinct_enough(rows).collect()) == [1, 3]


def test_focus_ties(spark):
    """The same document and score for two questions: the better place in its own question decides."""
    from quillon.operators import discovery

    rows = [("q1", 7, 0.5, "no"), ("q1", 9, 0.5, "no"), ("q2", 9, 0.5, "no"), ("q1", 8, 0.5, "no")]
    for order in (rows, rows[::-1]):
        hits = spark.createDataFrame(order, "query string, doc_id int, score double, content string").withColumn("chunk_index", F.lit(0))
        got = discovery.focus(hits, ["x"], 10).orderBy("rank").collect()
        assert [(r["query"], r["doc_id"]) for r in got] == [("q1", 7), ("q1", 8), ("q2", 9), ("q1", 9)]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, "S", 0.5), (2, 3, "S", 0.5), (4, 5, "S", 1.0)], "source long, target long, type string, weight double")
    assert graph.shortest_path_length(edges, 1, 3) == 2 and graph.shortest_path_length(edges, 1, 5) is None
    assert {(r["node"], r["hop"], r["weight"]) for r in graph.related(edges, 1, 3).collect()} == {(2, 1, 0.5), (3, 2, 0.25)}
    assert {r["node"]: r["component"] for r in graph.connected(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    left, kept = graph.remove_nodes(nodes, edges, spark.createDataFrame([(2,)], "id long"))
    assert left.count() == 4 and kept.count() == 1


def test_components_of_all_orders(spark):
    """g5_components over the whole table against a plain union-find."""
    from quillon.plans import QUERIES

    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect():
        a, b = sorted((top(r[0]), top(r[1] + 1000000)))
        up[b] = a
    assert {r["node"]: r["component"] for r in QUERIES["g5_components"](spark, SMALL).collect()} == {x: top(x) for x in up}


def test_long_chain(spark):
    edges = spark.range(199).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    assert graph.connected(edges).where("component <> 0").count() == 0


@pytest.mark.parametrize("values", [[3.0], [2.0, 1.0], [5.0, -1.0, 5.0, 0.0, 5e-324, 1e300], [float(i % 7) / 3 for i in range(50)], [0.0] * 9 + [1.0, float("nan"), float("inf")]])
def test_middle_value(spark, values):
    df = spark.createDataFrame([(values,)], "embedding array<double>")
    finite = sorted(v for v in values if abs(v) < float("inf"))
    assert quantize.middle_value(df, bins=4) == finite[len(finite) // 2]
    assert quantize.middle_value(df.limit(0)) == 0 and quantize.product_train(df.limit(0), 2, 2).count() == 0


def test_expansions():
    assert rerank.expand_words("CMMV api") == ["CMMV api", "CMMV", "CMMV api", "Contract Model View framework", "TypeScript framework", "application programming interface", "REST API"]
    assert rerank.expand_templates("What is the Store", 15)[1:4] == ["Store definition", "what is Store", "Store features"]
    assert len(rerank.expand_templates("x", 99)) == 15


def test_merge_patch():
    assert dml.merged_json({"a": 1, "b": {"c": 1, "d": 2}}, {"a": None, "b": {"c": 3}}) == {"b": {"c": 3, "d": 2}}


def test_delete_needs_a_filter(spark):
    with pytest.raises(ValueError):
        dml.delete_where(spark.range(3), None)


def test_sources(spark, tmp_path):
    points = spark.createDataFrame([("1", [1.0, 2.0], '{"a":1}'), ("x", [3.0], '{"b":[1,2]}')], readers.POINTS)
    readers.export_json(points, f"{tmp_path}/json")
    assert sorted(map(tuple, readers.import_json(spark, f"{tmp_path}/json").collect())) == sorted(map(tuple, points.collect()))
    readers.snapshot(points, f"{tmp_path}/snap", 1)
    readers.snapshot(points.limit(1), f"{tmp_path}/snap", 2)
    assert readers.versions(spark, f"{tmp_path}/snap") == [1, 2]
    assert readers.restore(spark, f"{tmp_path}/snap", 1).count() == 2 and readers.restore(spark, f"{tmp_path}/snap").count() == 1
    log = spark.createDataFrame([(1, "upsert", "a"), (2, "delete", "a"), (3, "upsert", "b")], "seq long, op string, id string")
    readers.append_log(log, f"{tmp_path}/log")
    assert [r["id"] for r in dml.replay(readers.read_log(spark, f"{tmp_path}/log")).collect()] == ["b"]
    assert value(spark, readers.markdown(F.lit('<h1>T</h1><p>a <a href="/u">l</a></p>'))) == "# T\na [l](/u)"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "upsert", "a", 1.0), (2, "upsert", "b", 2.0)], "seq long, op string, id string, value double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/1")
    stream = lambda: jobs.changes(spark, f"{tmp_path}/in/*", "seq long, op string, id string, value double")
    jobs.upserts(stream(), f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/version=0").count() == 2
    spark.createDataFrame([(3, "delete", "a", 0.0), (4, "upsert", "b", 5.0)], "seq long, op string, id string, value double").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    jobs.upserts(stream(), f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    assert [(r["id"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/out/version=1").collect()] == [("b", 5.0)]
    events = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    got = jobs.drain(jobs.usage(events), spark, "usage_test", "complete")
    assert got.agg(F.sum("n")).first()[0] == 1000


def test_char_ngrams(spark):
    from quillon.functions.text import char_ngrams

    texts = ["", "ab", "ABCD", "a\nbc d", "x😀yz😀", "ab cd " * 5_000, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", char_ngrams(F.col("t"), 3).alias("g")).collect()
    for r in rows:
        low = (texts[r["i"]] or "").lower()
        assert r["g"] == (None if texts[r["i"]] is None else [low] if len(low) <= 3 else [low[k : k + 3] for k in range(len(low) - 2)])


def test_term_counts_where_documents_are_read(spark, monkeypatch):
    """n-grams and words against plain counts: short, null, empty and odd texts, repeated keys, pieces; and no shuffle of a row a character."""
    from collections import Counter

    monkeypatch.setattr(embed, "PIECE", 40)
    texts = [(1, "Banana band"), (2, "ab"), (3, ""), (4, None), (5, "x😀yz😀x😀y a\0b"), (6, "aaaa " * 30), (7, "ban ana"), (7, "banana, «ban» --"), (None, "abc abc"), (None, "abc")]
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    grams = lambda t: [t] if len(t) <= 3 else [t[i : i + 3] for i in range(len(t) - 2)]
    words = lambda t: [w for w in (p.strip("«»-,\0😀") for p in t.split()) if w]
    for of, got in ((grams, embed.char_gram_counts(docs, "doc_id", "text")), (words, embed.bag_of_words(docs, "doc_id", "text"))):
        want = {}
        for k in {k for k, _ in texts}:
            tf = Counter(g for i, t in texts if i == k and t is not None for g in of(t.lower()))
            size = sum(n * n for n in tf.values()) ** 0.5
            want |= {(k, g): n / size for g, n in tf.items()}
        rows = {(r["doc_id"], r["term"]): r["weight"] for r in got.collect()}
        assert rows.keys() == want.keys() and all(rows[x] == pytest.approx(want[x]) for x in want)
        plan = embed.char_gram_counts(docs.limit(0), "doc_id", "text")._jdf.queryExecution().toString()
        assert "Generate" not in plan and "Window" not in plan


def test_tokens(spark):
    texts = ["a  b\u00a0c", "«Hi», it's -- (x_1)!", "", "--- ...", "é9. ÀB\t\nz", "1,000.5% ab😀cd 😀q😀", "a\u2003b\x1fc\x0bd\u180ee", "a-" * 50_000, "x" * 50_000, "!" * 50_000 + "a" + "!" * 50_000]
    was = lambda c: F.filter(F.transform(F.split(F.lower(c), r"(?U)\s+"), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda t: t != "")
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.tokens(F.col("t")).alias("now"), was(F.col("t")).alias("was")).collect():
        assert r["now"] == r["was"]


def test_overlap_and_long_files():
    """The longest common end and start, as trying every length finds it; a long file in time linear in its chunks (36 MB; neighbouring parts may share some digits)."""
    import random
    import time

    random.seed(3)
    for _ in range(3000):
        a, b = (bytes(random.choice(b"ab") for _ in range(random.randrange(14))) for _ in range(2))
        assert files.overlap(a, b) == next((n for n in range(min(len(a), len(b)), 0, -1) if a.endswith(b[:n])), 0), (a, b)
    parts = [f"{i:06d}" * 300 for i in range(20_000)]
    start = time.time()
    assert len(files.joined_text(parts)) > 35_900_000 and time.time() - start < 20


def test_chunks_come_in_small_batches(spark, monkeypatch):
    """What a worker holds of a batch of files is bounded, and files come back from their chunks."""
    rows = [(f"f{i}", f"Satz {i} über {i}. " * (i * 40)) for i in range(12)]
    monkeypatch.setattr(tx, "HELD", 3000)
    got = tx.chunks(spark.createDataFrame(rows, "p string, t string"), "p", "t", 512, 64)
    assert sorted((r["path"], r["chunk_index"], r["start"], r["content"]) for r in got.collect()) == sorted((p, i, a, c) for p, t in rows for i, (a, c) in enumerate(tx.chunk(t, 512, 64)))
    assert {r["path"]: r["content"] for r in files.contents(got).collect()} == {p: files.joined_text([c for _, c in tx.chunk(t, 512, 64)]) for p, t in rows if t}


def test_components_with_a_hot_label(spark):
    """One label for nearly all nodes: its rows are not dealt to one task, and components stay right."""
    star = spark.range(1, 400).select(F.lit(0).cast("long").alias("source"), F.col("id").alias("target"))
    pairs = spark.range(1000, 1040).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target")).where("source % 2 = 0")
    for hot in (5, 10_000):
        got = {r["node"]: r["component"] for r in graph.connected(star.union(pairs), hot=hot).collect()}
        assert got == {i: 0 for i in range(400)} | {i: i - i % 2 for i in range(1000, 1040)}
