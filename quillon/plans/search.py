"""Queries of the vector side: kernels, sparse vectors, searches, predicates, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import predicates, sparse, vectors
from quillon.operators import search
from quillon.plans.base import query, table

_V = "embedding::double[]"
#: Cosine of e and q in SQL.
_COS = "list_dot_product(e.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])))"
_DOT = "list_dot_product(e.embedding::double[], q.embedding::double[])"


def vector_of(emb: DataFrame, vec_id: int) -> list[float]:
    return search.mean_vector(emb, [vec_id])


def queries_of(emb: DataFrame, where: str) -> DataFrame:
    return emb.where(where).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def top_sql(score: str = _COS, k: int = 10, source: str = "embeddings e, embeddings q where q.vec_id = 0", more: str = "") -> str:
    return f"select vec_id, score, rank {more} from (select *, row_number() over (order by score desc, vec_id) rank from (select e.vec_id, e.label, round({score}, 6) score from {source})) where rank <= {k}"


@query(f"""select e.vec_id, round({_DOT}, 6) dot, round(list_distance(e.embedding::double[], q.embedding::double[]), 6) l2, round(greatest(-1, least(1, {_DOT})), 6) clamped,
 round({_COS}, 6) cosine, round(sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])), 6) norm,
 round(list_sum(list_transform(list_zip(e.embedding::double[], q.embedding::double[]), lambda x: abs(x[1] - x[2]))), 6) l1,
 (list_position(e.embedding, list_min(e.embedding)) - 1)::int argmin from embeddings e, embeddings q where q.vec_id = 0""")
def k1_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    q = search.literal(vector_of(emb, 0))
    e = F.col("embedding")
    return emb.select("vec_id", F.round(vectors.dot(e, q), 6).alias("dot"), F.round(vectors.euclidean(e, q), 6).alias("l2"), F.round(vectors.clamped_cosine(e, q), 6).alias("clamped"), F.round(vectors.cosine(e, q), 6).alias("cosine"), F.round(vectors.norm(e), 6).alias("norm"), F.round(vectors.manhattan(e, q), 6).alias("l1"), vectors.argmin(e).alias("argmin"))


@query("""with n as (select vec_id, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings)
select vec_id, round(list_sum(list_transform(v, lambda x: x / n)), 6) unit_sum, round(list_sum(list_transform(v, lambda x: x + 2 * x)), 6) added, round(list_sum(list_transform(v, lambda x: x - 0.5 * x)), 6) subtracted from n""")
def k6_elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    part = lambda v: F.round(vectors.total(v), 6)
    return table(spark, sf_dir, "embeddings").select("vec_id", part(vectors.normalize(e)).alias("unit_sum"), part(vectors.add(e, vectors.scale(e, 2.0))).alias("added"), part(vectors.subtract(e, vectors.scale(e, 0.5))).alias("subtracted"))


@query("select vec_id, list_sum(list_transform(embedding, lambda x: (round(x * 100)::int) * (round(x * 50)::int)))::int int_dot from embeddings")
def k10_int8_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = lambda by: F.transform("embedding", lambda x: F.round(x * by).cast("tinyint"))
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.int8_dot(codes(F.lit(100).cast("float")), codes(F.lit(50).cast("float"))).alias("int_dot"))


@query(f"""select e.vec_id, round({_COS}, 6) s_cos, round(1 / (1 + exp(-{_DOT})), 6) s_dot, round(1 / (1 + list_distance(e.embedding::double[], q.embedding::double[])), 6) s_l2,
 round(exp(-list_distance(e.embedding::double[], q.embedding::double[])), 6) u_l2, round((1 - {_COS} + 1) / 2, 6) u_cos, round(0 - list_distance(e.embedding::double[], q.embedding::double[]), 6) m_l2, round({_DOT}, 6) m_dot from embeddings e, embeddings q where q.vec_id = 1""")
def k11_score_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    q, e = search.literal(vector_of(emb, 1)), F.col("embedding")
    named = {"s_cos": vectors.search_score("cosine", e, q), "s_dot": vectors.search_score("dot", e, q), "s_l2": vectors.search_score("euclidean", e, q), "u_l2": vectors.distance_score("euclidean", vectors.euclidean(e, q)), "u_cos": vectors.distance_score("cosine", 1 - vectors.cosine(e, q)), "m_l2": vectors.matrix_score("euclidean", e, q), "m_dot": vectors.matrix_score("dot", e, q)}
    return emb.select("vec_id", *(F.round(v, 6).alias(k) for k, v in named.items()))


def kept(emb: DataFrame, least: float = 0.15) -> DataFrame:
    """Embeddings with small components set to zero, as sparse vectors."""
    return emb.select("vec_id", "label", sparse.from_dense(F.transform("embedding", lambda x: F.when(F.abs(x) >= least, x.cast("double")).otherwise(0.0))).alias("s"))


_SP = "(select vec_id, label, unnest(generate_series(0, len(embedding) - 1)) idx, unnest(embedding)::double val from embeddings)"


@query(f"select vec_id, count(*)::int nnz, round(1 - count(*) / 64.0::double, 6) sparsity, round(sqrt(sum(val * val)), 6) norm, true valid, round(sum(val), 6) dense_sum from {_SP} where abs(val) >= 0.15 group by vec_id")
def p1_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    rows = kept(table(spark, sf_dir, "embeddings")).where(sparse.nnz(s) > 0)
    return rows.select("vec_id", sparse.nnz(s).alias("nnz"), F.round(sparse.sparsity(s, 64), 6).alias("sparsity"), F.round(sparse.norm(s), 6).alias("norm"), sparse.valid(s).alias("valid"), F.round(vectors.total(sparse.to_dense(s, 64)), 6).alias("dense_sum"))


@query(f"""with p as (select * from {_SP} where abs(val) >= 0.15), n as (select vec_id, sqrt(sum(val * val)) n from p group by vec_id),
d as (select a.vec_id a, b.vec_id b, sum(a.val * b.val) dot from p a join p b on a.idx = b.idx and b.vec_id = a.vec_id + 1 group by all)
select x.vec_id a, y.vec_id b, round(coalesce(dot, 0), 6) dot, round(coalesce(dot / (x.n * y.n), 0), 6) cosine from n x join n y on y.vec_id = x.vec_id + 1 left join d on d.a = x.vec_id""")
def p3_sparse_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(table(spark, sf_dir, "embeddings")).where(sparse.nnz(F.col("s")) > 0)
    a, b = rows.select(F.col("vec_id").alias("a"), F.col("s").alias("x")), rows.select(F.col("vec_id").alias("b"), F.col("s").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(sparse.dot(F.col("x"), F.col("y")), 6).alias("dot"), F.round(sparse.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


_SPARSE_SCORE = f"(select e.vec_id, coalesce(sum(p.val * q.val), 0) score from embeddings e left join (select * from {_SP} where abs(val) >= 0.15) p on p.vec_id = e.vec_id left join (select * from {_SP} where abs(val) >= 0.15 and vec_id = 0) q on q.idx = p.idx group by e.vec_id)"


def sparse_scores(emb: DataFrame) -> DataFrame:
    rows = kept(emb)
    q = sparse.postings(rows.where("vec_id = 0"), "vec_id", "s")
    return sparse.scores(rows, q, "vec_id", "s").withColumn("score", F.round("score", 6))


def sparse_top(emb: DataFrame, k: int) -> DataFrame:
    return search.ranked(sparse_scores(emb), k)


@query(f"select vec_id, score, rank from (select vec_id, round(score, 6) score, row_number() over (order by round(score, 6) desc, vec_id) rank from {_SPARSE_SCORE}) where rank <= 15")
def p6_sparse_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_top(table(spark, sf_dir, "embeddings"), 15)


@query(f"select idx, count(*) docs, round(sum(val), 6) mass from {_SP} where abs(val) >= 0.15 group by idx")
def p7_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.postings(kept(table(spark, sf_dir, "embeddings")), "vec_id", "s").groupBy(F.col("idx").cast("long").alias("idx")).agg(F.count("*").alias("docs"), F.round(F.sum("val"), 6).alias("mass"))


@query(top_sql())
def q1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return search.knn(emb, vector_of(emb, 0), 10).select("vec_id", "score", "rank")


@query(top_sql(f"1 / (1 + list_distance(e.embedding::double[], q.embedding::double[]))"))
def q1_knn_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return search.knn(emb, vector_of(emb, 0), 10, "euclidean").select("vec_id", "score", "rank")


@query("select * from (" + top_sql() + ") where score >= 0.3")
def q3_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return search.over(search.knn(emb, vector_of(emb, 0), 10), 0.3).select("vec_id", "score", "rank")


_BATCH = f"select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from (select q.vec_id query_id, e.vec_id, e.label, q.label query_label, round({_COS}, 6) score from embeddings e join embeddings q on q.vec_id % 50 = 0 and e.vec_id <> q.vec_id)) where rank <= 10"


@query(_BATCH)
def q4_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return search.batch_knn(emb, queries_of(emb, "vec_id % 50 = 0"), 10).select("query_id", "vec_id", "score", "rank")


@query()
def q5_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with the number of rows scored beside them."""
    emb = table(spark, sf_dir, "embeddings")
    return search.knn(emb, vector_of(emb, 0), 10).select("vec_id", "score", "rank").join(emb.agg(F.count("*").alias("scored")))


_LISTS = f"""d as (select vec_id, score, rank from (select *, row_number() over (order by score desc, vec_id) rank from (select e.vec_id, round({_COS}, 6) score from embeddings e, embeddings q where q.vec_id = 0)) where rank <= 20),
s as (select vec_id, score, rank from (select vec_id, round(score, 6) score, row_number() over (order by round(score, 6) desc, vec_id) rank from {_SPARSE_SCORE}) where rank <= 20)"""


def fused_sql(score: str) -> str:
    return f"with {_LISTS}, f as (select coalesce(d.vec_id, s.vec_id) vec_id, d.score dense_score, d.rank dense_rank, s.score sparse_score, s.rank sparse_rank, round({score}, 6) score from d full join s on d.vec_id = s.vec_id) select vec_id, score, rank from (select *, row_number() over (order by score desc, vec_id) rank from f) where rank <= 10"


def hybrid_of(spark: SparkSession, sf_dir: str, fusion: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return search.hybrid(search.knn(emb, vector_of(emb, 0), 20), sparse_top(emb, 20), 10, 0.7, fusion).select("vec_id", "score", "rank")


@query(fused_sql("coalesce(0.7 * d.score + 0.7::double / (60 + d.rank), 0) + coalesce((1 - 0.7::double) * s.score + (1 - 0.7::double) / (60 + s.rank), 0)"))
def q7_hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_of(spark, sf_dir, "rrf")


@query(fused_sql("0.7::double * coalesce(d.score, 0) + (1 - 0.7::double) * coalesce(s.score, 0)"))
def q8_hybrid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_of(spark, sf_dir, "weighted")


@query(fused_sql("0.7::double * coalesce(d.score / (select max(score) from d), 0) + (1 - 0.7::double) * coalesce(s.score / (select max(score) from s), 0)"))
def q9_hybrid_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_of(spark, sf_dir, "alpha")


@query(f"with {_LISTS} select vec_id, score, rank from (select *, row_number() over (order by score desc, vec_id) rank from (select e.vec_id, round({_COS}, 6) score from embeddings e join s on s.vec_id = e.vec_id, embeddings q where q.vec_id = 0)) where rank <= 5")
def q12_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return search.two_stage(sparse_top(emb, 20), emb, vector_of(emb, 0), 5).select("vec_id", "score", "rank")


@query(f"""with b as (select e.vec_id, e.label, round({_COS}, 6) score from embeddings e, embeddings q where q.vec_id = 0),
o as (select *, row_number() over (partition by label order by score desc, vec_id) own from b),
m as (select vec_id, label::varchar collection, round(score * case label when 3 then 1 + 0.1::double * 3 when 1 then 1 + 0.1::double * 2 when 4 then 1 + 0.1::double * 1 else 1 end, 6) score from o where own <= 5)
select vec_id, collection, score, rank from (select *, row_number() over (order by score desc, vec_id) rank from m) where rank <= 20""")
def q13_multi_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").withColumn("collection", F.col("label").cast("string"))
    scored = emb.withColumn("score", F.round(vectors.cosine(F.col("embedding"), search.literal(vector_of(emb, 0))), 6))
    return search.boosted(scored, ["3", "1", "4"]).select("vec_id", "collection", "score", "rank")


@query(f"select vec_id, shard, score, rank from (select *, row_number() over (order by score desc, vec_id) rank from (select *, row_number() over (partition by shard order by score desc, vec_id) own from (select e.vec_id, (e.vec_id % 4)::int shard, round({_COS}, 6) score from embeddings e, embeddings q where q.vec_id = 0)) where own <= 10) where rank <= 10")
def q14_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    scored = emb.select("vec_id", (F.col("vec_id") % 4).cast("int").alias("shard"), F.round(vectors.cosine(F.col("embedding"), search.literal(vector_of(emb, 0))), 6).alias("score"))
    own = search.ranked(scored, 10, by=("shard",), as_rank="own")
    return search.ranked(own.drop("own"), 10).select("vec_id", "shard", "score", "rank")


@query(f"""with d0 as (select e.vec_id, (e.vec_id % 4)::int shard, round({_COS}, 6) score from embeddings e, embeddings q where q.vec_id = 0),
d as (select * from (select *, row_number() over (partition by shard order by score desc, vec_id) rank from d0) where rank <= 10),
s0 as (select vec_id, (vec_id % 4)::int shard, round(score, 6) score from {_SPARSE_SCORE}), s as (select * from (select *, row_number() over (partition by shard order by score desc, vec_id) rank from s0) where rank <= 10),
f as (select coalesce(d.vec_id, s.vec_id) vec_id, round(coalesce(0.7 * d.score + 0.7::double / (60 + d.rank), 0) + coalesce((1 - 0.7::double) * s.score + (1 - 0.7::double) / (60 + s.rank), 0), 6) score from d full join s on d.vec_id = s.vec_id)
select * from (select vec_id, score, row_number() over (order by score desc, vec_id) rank from f) where rank <= 10""")
def q15_sharded_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion with ranks local to each shard, then the best of all."""
    emb = table(spark, sf_dir, "embeddings")
    shard = (F.col("vec_id") % 4).cast("int")
    dense = emb.select("vec_id", shard.alias("shard"), F.round(vectors.cosine(F.col("embedding"), search.literal(vector_of(emb, 0))), 6).alias("score"))
    thin = sparse_scores(emb).select("vec_id", shard.alias("shard"), "score")
    local = lambda df: search.ranked(df, 10, by=("shard",))
    fused = search.additive_rrf(search.both_lists(local(dense), local(thin)))
    return search.ranked(fused.withColumn("score", F.round("score", 6)), 10).select("vec_id", "score", "rank")


_PAYLOAD = "{'vec_id': vec_id, 'label': label, 'bucket': vec_id % 5}"


@query(f"select * from (select vec_id, score, row_number() over (order by score desc, vec_id) rank from (select e.vec_id, round({_COS}, 6) score from embeddings e, embeddings q where q.vec_id = 0 and e.vec_id % 5 = 2)) where rank > 3 and rank <= 13 and score >= 0.1")
def d1_points_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return search.points_search(emb, vector_of(emb, 0), 10, 3, 0.1, F.col("vec_id") % 5 == 2).select("vec_id", "score", "rank")


@query(f"select vec_id, score, rank from (select *, row_number() over (order by score desc, vec_id) rank from (select e.vec_id, round({_COS}, 6) score from embeddings e, embeddings q where q.vec_id = 0)) where rank > 3 and rank <= 23 and score >= 0.1 and vec_id % 5 = 2")
def d1_points_search_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return search.points_search(emb, vector_of(emb, 0), 20, 3, 0.1, F.col("vec_id") % 5 == 2, compat=True).select("vec_id", "score", "rank")


def recommend_sql(target: str) -> str:
    return f"""with x as (select vec_id, unnest(generate_series(1, 64)) i, unnest(embedding)::double x from embeddings), t as (select i, {target} x from x group by i), t2 as (select list(x order by i) v from t)
select vec_id, score, rank from (select *, row_number() over (order by score desc, vec_id) rank from (select e.vec_id, round(list_dot_product(e.embedding::double[], v) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(v, v))), 6) score from embeddings e, t2)) where rank <= 10"""


def recommended(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return search.knn(emb, search.recommend_vector(emb, [1, 2, 3], [4, 5], strategy), 10).select("vec_id", "score", "rank")


@query(recommend_sql("avg(x) filter (where vec_id in (1, 2, 3)) - sum(x) filter (where vec_id in (4, 5)) / 3"))
def d4_query_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommended(spark, sf_dir, "query")


@query(recommend_sql("avg(x) filter (where vec_id in (1, 2, 3))"))
def d8_recommend_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommended(spark, sf_dir, "average")


@query(recommend_sql("avg(x) filter (where vec_id = 1)"))
def d8_recommend_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommended(spark, sf_dir, "best")


@query(recommend_sql("avg(x) filter (where vec_id = 7)"))
def d5_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target alone decides; a context is not looked at."""
    emb = table(spark, sf_dir, "embeddings")
    return search.knn(emb, vector_of(emb, 7), 10).select("vec_id", "score", "rank")


@query(recommend_sql("avg(x) filter (where vec_id in (8, 9))"))
def d6_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return search.knn(emb, search.mean_vector(emb, [8, 9]), 10).select("vec_id", "score", "rank")


@query(f"""with s as (select q.vec_id qid, e.vec_id, e.label, round({_COS}, 6) score from embeddings e, embeddings q where q.vec_id in (0, 1, 2)),
r as (select *, row_number() over (partition by qid order by score desc, vec_id) rank from s),
c as (select vec_id from r where qid = 0 and rank <= 40 and vec_id in (select vec_id from r where qid = 1 and rank <= 200) union select vec_id from r where qid = 2 and rank <= 30 and score >= 0.1)
select * from (select vec_id, score, row_number() over (order by score desc, vec_id) rank from s where qid = 0 and vec_id in (select vec_id from c)) where rank <= 10""")
def d7_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    stages = [{"query": vector_of(emb, 0), "limit": 40, "prefetch": [{"query": vector_of(emb, 1), "limit": 200}]}, {"query": vector_of(emb, 2), "limit": 30, "least": 0.1}]
    return search.knn(emb.join(search.prefetch(emb, stages), "vec_id", "left_semi"), vector_of(emb, 0), 10).select("vec_id", "score", "rank")


_GROUPS = f"""r as (select * from (select *, row_number() over (order by score desc, vec_id) rank from (select e.vec_id, e.label, round({_COS}, 6) score from embeddings e, embeddings q where q.vec_id = 0)) where rank <= 60),
h as (select * from (select label::varchar group_id, vec_id, score, row_number() over (partition by label order by score desc, vec_id) hit_rank from r) where hit_rank <= 4),
g as (select group_id, row_number() over (order by score desc, vec_id) group_rank from h where hit_rank = 1)"""


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return search.groups(search.knn(emb, vector_of(emb, 0), 60), F.col("label"), 5, 4)


@query(f"with {_GROUPS} select h.*, group_rank from h join g using (group_id) where group_rank <= 5")
def d10_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark, sf_dir).select("group_id", "vec_id", "score", "hit_rank", "group_rank")


@query(f"with {_GROUPS} select h.group_id, h.vec_id, n_name from h join g using (group_id) left join nation on n_nationkey::varchar = h.group_id where group_rank <= 5")
def d13_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = grouped(spark, sf_dir)
    return search.with_lookup(hits, table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("string") == F.col("group_id")).select("group_id", "vec_id", "n_name")


_PAIRS = f"(select q.vec_id a, e.vec_id b, round({_COS}, 6) score from (select * from embeddings where vec_id in (select vec_id from embeddings order by vec_id limit 10)) q join (select * from embeddings where vec_id in (select vec_id from embeddings order by vec_id limit 10)) e on q.vec_id < e.vec_id)"


@query(f"select a, b, score from {_PAIRS}")
def d14_matrix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matrix_pairs(table(spark, sf_dir, "embeddings")).select("a", "b", "score")


@query(f"select a, coalesce(sum(n) over (order by a rows between unbounded preceding and 1 preceding), 0)::bigint as offset, columns, scores from (select a, count(*) n, list(b order by b) columns, list(score order by b) scores from {_PAIRS} group by a)")
def d15_matrix_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matrix_offsets(search.matrix_pairs(table(spark, sf_dir, "embeddings")))


@query("select vec_id, label from embeddings where vec_id > 100 order by vec_id limit 25")
def d16_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scroll(table(spark, sf_dir, "embeddings"), 100, 25).select("vec_id", "label")


@query("select count(*) as count from embeddings where label = 3")
def d17_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count(table(spark, sf_dir, "embeddings"), F.col("label") == 3)


@query("select vec_id, label from embeddings where vec_id in (3, 5, 8, 999999)")
def d18_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin([3, 5, 8, 999999])).select("vec_id", "label")


@query("select label as value, count(*) as count from embeddings group by label order by 2 desc, 1 limit 5")
def d21_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facet(table(spark, sf_dir, "embeddings"), F.col("label"), 5)


# Predicates over JSON payloads.


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    inner = F.struct(F.struct((key % 50).alias("age")).alias("profile"), F.col("c_mktsegment").alias("segment"))
    tags = F.transform(F.sequence(F.lit(0), (key % 4).cast("int")), lambda i: F.concat(F.lit("t"), i.cast("string")))
    place = F.struct(((key * 37) % 180 - 90).cast("double").alias("lat"), ((key * 91) % 360 - 180).cast("double").alias("lon"))
    return c.select("c_custkey", "c_acctbal", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"), (key % 2 == 0).alias("even"), F.when(key % 3 == 0, F.lit("yes")).alias("third"), inner.alias("user"), tags.alias("tags"), place.alias("location"))).alias("payload"))


def filtered(spark: SparkSession, sf_dir: str, tree: dict) -> DataFrame:
    return customers(spark, sf_dir).where(predicates.compiled(F.col("payload"), tree)).select("c_custkey")


_ID = "select c_custkey from customer where "


@query(_ID + "c_nationkey = 7 or c_mktsegment = 'BUILDING' and c_custkey % 2 = 0")
def f1_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = {"must": [{"key": "user.segment", "match": {"value": "BUILDING"}}, {"key": "even", "match": {"value": True}}]}
    return filtered(spark, sf_dir, {"should": [{"key": "nation", "match": {"value": 7}}, both]})


@query(_ID + "c_custkey % 3 = 0")
def f2_match_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, {"must": [{"key": "third", "match": {"any": True}}]})


@query(_ID + "c_custkey % 3 <> 0 and c_nationkey <> 3")
def f2_must_not_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, {"must_not": [{"key": "third", "match": {"value": "yes"}}, {"key": "nation", "match": {"value": 3}}, {"key": "absent", "match": {"value": 1}}]})


@query(_ID + "c_name like '%00001%' and c_name like '%7' and starts_with(c_name, 'Customer')")
def f3_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda text, how: {"key": "name", "match": {"text": text, "how": how}}
    return filtered(spark, sf_dir, {"must": [of("00001", "contains"), of("7", "suffix"), of("Customer", "prefix")]})


@query(_ID + "c_acctbal >= 1000 and c_acctbal < 4000 and c_custkey % 50 > 20")
def f4_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, {"must": [{"key": "balance", "range": {"gte": 1000, "lt": 4000}}, {"key": "user.profile.age", "range": {"gt": 20}}]})


@query(_ID + "(c_custkey * 37) % 180 - 90 between 10 and 60 and (c_custkey * 91) % 360 - 180 between -100 and 20")
def f5_geo_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, {"must": [{"key": "location", "geo_box": {"min_lat": 10, "max_lat": 60, "min_lon": -100, "max_lon": 20}}]})


@query("select c_custkey from (select c_custkey, radians(((c_custkey * 37) % 180 - 90)::double) a, radians(48.5::double) b, radians(2.3::double - ((c_custkey * 91) % 360 - 180)::double) d from customer) where 2 * 6371000 * asin(sqrt(least(1.0, pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin(d / 2), 2)))) <= 3000000")
def f6_geo_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, {"must": [{"key": "location", "geo_radius": {"lat": 48.5, "lon": 2.3, "radius": 3_000_000}}]})


@query(_ID + "c_custkey % 4 + 1 >= 3 and strlen(c_name) >= 4")
def f7_values_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, {"must": [{"key": "tags", "values_count": {"gte": 3}}, {"key": "name", "values_count": {"gte": 4}}, {"key": "user", "values_count": {"gte": 2}}]})


@query("select event_id from events where (props::json->>'k')::int between 10 and 60")
def f11_events_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(predicates.compiled(F.col("props"), {"must": [{"key": "k", "range": {"gte": 10, "lte": 60}}]})).select("event_id")


@query("select doc_id from documents where list_has_all(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), ['the', 'that', 'with'])")
def f12_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(predicates.has_terms(F.col("text"), "The that with")).select("doc_id")


@query("select distinct source from documents where source glob 'src1*' and not source glob 'src1[0-4]'")
def f15_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source").distinct().where(predicates.glob(F.col("source"), ["src1*"], ["src1[0-4]"]))


@query("""with j as (select e.vec_id, q.label = e.label as relevant, q.vec_id query_id, rank from (""" + _BATCH + """) r join embeddings q on q.vec_id = r.query_id join embeddings e on e.vec_id = r.vec_id)
select query_id, count(*) filter (where relevant) hits, round(count(*) filter (where relevant) / 10.0::double, 6) as "precision" from j group by query_id""")
def a1_precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    found = search.batch_knn(emb, emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label")), 10)
    hit = F.when(F.col("label") == F.col("query_label"), 1).otherwise(0)
    return found.groupBy("query_id").agg(F.sum(hit).alias("hits"), F.round(F.sum(hit) / F.lit(10.0), 6).alias("precision"))


