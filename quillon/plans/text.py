"""Queries of the text side: embeddings, text functions, rerankers, discovery, files, graphs, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.functions.store import cut
from quillon.operators import discovery, dml, embed, evaluate, files, graph, quantize, rerank, search
from quillon.plans.base import query, table
from quillon.plans.search import _BATCH, _COS, queries_of, vector_of

#: Tokens of documents in SQL.
_TOK = r"(select doc_id, count(*) over (partition by doc_id) len, term from (select doc_id, regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') term from (select doc_id, unnest(string_split_regex(lower(text), '\s+')) w from documents)) where term <> '')"
_TF = f"tf as (select doc_id, len, term, count(*) tf from {_TOK} group by all)"
_VOC = "voc as (select term, sum(tf) n, count(*) df from tf group by term order by n desc, term limit 512)"
_BM25 = f"""{_TF}, {_VOC}, st as (select count(*) n, avg(len) m from (select doc_id, max(len) len from tf group by doc_id)),
w as (select doc_id, tf.term, ln((st.n - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.5 / (tf + 1.5 * (0.25::double + 0.75::double * len / m)) weight from tf join voc using (term), st)"""


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"with {_TF}, {_VOC} select term, n, df, (row_number() over (order by n desc, term) - 1)::int as index from voc")
def e1_bm25_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.BM25.fit(docs_of(spark, sf_dir), "doc_id", "text").vocabulary.select("term", "n", "df", "index")


@query(f"with {_BM25} select doc_id, term, round(weight, 5) weight from w")
def e2_bm25_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    return embed.BM25.fit(docs, "doc_id", "text").weights(docs, "doc_id", "text").withColumn("weight", F.round("weight", 5))


@query(f"""with {_BM25}, n as (select doc_id, sqrt(sum(weight * weight)) n from w group by doc_id), u as (select w.doc_id, term, weight / n.n weight from w join n using (doc_id)),
s as (select a.doc_id, round(sum(a.weight * b.weight), 6) score from u a join u b on a.term = b.term and b.doc_id = 3 group by a.doc_id)
select * from (select doc_id, score, row_number() over (order by score desc, doc_id) rank from s) where rank <= 10""")
def e3_bm25_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    rows = embed.BM25.fit(docs, "doc_id", "text").weights(docs, "doc_id", "text", unit=True)
    found = embed.retrieve(rows, rows.where("doc_id = 3"), "doc_id").withColumn("score", F.round("score", 6))
    return search.ranked(found, 10, key="doc_id")


_LONG = r"(select doc_id, count(*) over (partition by doc_id) len, term from (select doc_id, regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') term from (select doc_id, unnest(string_split_regex(lower(text), '\s+')) w from documents) where strlen(w) > 2) where term <> '')"


@query(f"""with tf as (select doc_id, len, term, count(*) tf from {_LONG} group by all),
v0 as (select term, sum(tf) n, count(*) df, greatest(0, ln((select count(*) from documents)::double / count(*))) idf from tf group by term), v as (select * from v0 order by round(n * idf, 9) desc, term limit 512),
w as (select doc_id, term, tf / len::double * idf weight from tf join v using (term) where idf > 0), n as (select doc_id, sqrt(sum(weight * weight)) n from w group by doc_id)
select doc_id, term, round(weight / n.n, 5) weight from w join n using (doc_id)""")
def e4_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.tfidf(docs_of(spark, sf_dir), "doc_id", "text").withColumn("weight", F.round("weight", 5))


@query(f"with {_TF}, {_VOC}, w as (select doc_id, term, tf::double weight from tf join voc using (term)), n as (select doc_id, sqrt(sum(weight * weight)) n from w group by doc_id) select doc_id, term, round(weight / n.n, 6) weight from w join n using (doc_id)")
def e5_bag_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.bag_of_words(docs_of(spark, sf_dir), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query("""with g as (select doc_id, unnest(list_transform(generate_series(1, greatest(1, length(lower(text)) - 2)), lambda i: substr(lower(text), i, 3))) term from documents), tf as (select doc_id, term, count(*) tf from g group by all),
voc as (select term, sum(tf) n from tf group by term order by n desc, term limit 512), w as (select doc_id, term, tf::double weight from tf join voc using (term)), n as (select doc_id, sqrt(sum(weight * weight)) n from w group by doc_id) select doc_id, term, round(weight / n.n, 6) weight from w join n using (doc_id)""")
def e6_char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.char_gram_counts(docs_of(spark, sf_dir), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query()
def e7_random_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.projected(embed.tfidf(docs_of(spark, sf_dir), "doc_id", "text"), "doc_id")


@query()
def e8_hash_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", embed.hash_vector(F.col("text"), 32).alias("vector"))


# Quantisation.


@query("""with e as (select vec_id, embedding::double[] v, list_min(embedding)::double lo, list_max(embedding)::double - list_min(embedding)::double w from embeddings),
q as (select *, list_transform(v, lambda x: floor((x - lo) / w * 255)::int) codes from e)
select vec_id, list_sum(codes)::bigint code_sum, round(list_sum(list_transform(list_zip(v, codes), lambda p: pow(p[1] - (p[2] / 255.0::double * w + lo), 2))) / len(v), 8) error, list_sum(list_transform(v, lambda x: case when x > (lo + lo + w) / 2 then 1 else 0 end))::bigint ones from q""")
def z1_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("q", quantize.sq8(F.col("embedding")))
    add = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x).cast("long")
    return e.select("vec_id", add(F.col("q.codes")).alias("code_sum"), F.round(quantize.squared_error(F.col("embedding"), quantize.sq8_back(F.col("q"))), 8).alias("error"), add(quantize.binary(F.col("embedding"))).alias("ones"))


@query("""with r as (select min(list_min(embedding))::double lo, max(list_max(embedding))::double hi from embeddings), c as (select vec_id, embedding::double[] v, lo, hi, list_transform(embedding::double[], lambda x: greatest(0, least(15, round((x - lo) / (hi - lo) * 15)::int))) codes from embeddings, r)
select vec_id, list_sum(codes)::bigint code_sum, list_sum(list_transform(generate_series(1, 32), lambda k: codes[2 * k - 1] + 16 * codes[2 * k]))::bigint packed_sum, round(list_sum(list_transform(list_zip(v, codes), lambda p: pow(p[1] - (p[2] / 15.0::double * (hi - lo) + lo), 2))) / len(v), 8) error from c""")
def z3_global_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    low, high = quantize.value_range(emb)
    rows = emb.withColumn("codes", quantize.global_codes(F.col("embedding"), low, high, 4))
    add = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x).cast("long")
    return rows.select("vec_id", add(F.col("codes")).alias("code_sum"), add(quantize.packed(F.col("codes"), 4)).alias("packed_sum"), F.round(quantize.squared_error(F.col("embedding"), quantize.global_back(F.col("codes"), low, high, 4)), 8).alias("error"))


_MID = "(select x from (select x, row_number() over (order by x) - 1 rn, count(*) over () n from (select unnest(embedding)::double x from embeddings)) where rn = n // 2)"


@query(f"""with m as {_MID}, b as (select vec_id, list_transform(embedding::double[], lambda x: case when x > (select x from m) then 1 else 0 end) bits from (select * from embeddings))
select vec_id, list_sum(bits)::bigint ones from b""".replace("lambda x: case when x > (select x from m) then 1 else 0 end) bits from (select * from embeddings)", "lambda y: case when y > m.x then 1 else 0 end) bits from embeddings, m"))
def z4_global_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    bits = quantize.above(F.col("embedding"), quantize.middle_value(emb))
    return emb.select("vec_id", F.aggregate(bits, F.lit(0), lambda a, x: a + x).cast("long").alias("ones"))


_BITS = "b as (select vec_id, list_transform(embedding::double[], lambda x: case when x > (list_min(embedding)::double + list_max(embedding)::double) / 2 then 1 else 0 end) bits from embeddings)"


@query(f"with {_BITS}, s as (select x.vec_id, round(1 - list_sum(list_transform(list_zip(x.bits, y.bits), lambda p: case when p[1] <> p[2] then 1 else 0 end)) / 64.0::double, 6) score from b x, b y where y.vec_id = 0) select * from (select vec_id, score, row_number() over (order by score desc, vec_id) rank from s) where rank <= 10")
def z5_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").select("vec_id", quantize.binary(F.col("embedding")).alias("bits"))
    q = emb.where("vec_id = 0").select(F.col("bits").alias("q"))
    return search.ranked(emb.join(F.broadcast(q)).select("vec_id", F.round(quantize.hamming_similarity(F.col("bits"), F.col("q")), 6).alias("score")), 10)


@query()
def z6_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return quantize.product_encode(emb, quantize.product_train(emb, 8, 16))


# Text functions.


@query(r"select doc_id, len(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> ''))) n_words, round(len(list_filter(['the', 'de', 'der', 'that'], lambda t: contains(lower(text), t))) / 4.0::double, 6) tf, length(text) - length(replace(text, '.', '')) dots from documents")
def t6_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return docs_of(spark, sf_dir).select("doc_id", F.size(tx.word_set(text)).cast("long").alias("n_words"), F.round(tx.term_frequency(text, F.array(*map(F.lit, ("the", "de", "der", "that")))), 6).alias("tf"), (F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))).cast("long").alias("dots"))


@query(r"""with w as (select doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> '')) s from documents)
select a.doc_id a, b.doc_id b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::double, 6) jaccard from w a join w b on b.doc_id = a.doc_id + 1""")
def t6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of texts that follow one another, by id."""
    rows = docs_of(spark, sf_dir).select("doc_id", tx.word_set(F.col("text")).alias("s"))
    a, b = rows.toDF("a", "x"), rows.toDF("b", "y")
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(tx.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query()
def t1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(spark, sf_dir)


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir).withColumn("path", F.concat_ws("", "source", F.lit("/"), "doc_id", F.lit("."), "lang"))
    return tx.chunks(docs, "path", "text")


_NORM = r"regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+\n', chr(10), 'g'), '[ \t]+$', ''), '\n{3,}', chr(10) || chr(10), 'g')"


@query(f"select doc_id, sha256(regexp_replace(regexp_replace({_NORM}, '^\\s+', ''), '\\s+$', '')) hash from documents")
def t2_normalized_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", tx.content_hash(tx.normalized(F.col("text"), unicode=False)).alias("hash"))


@query("select sha256(text) hash, min(doc_id) doc_id, count(*) copies from documents group by 1 having count(*) > 1")
def t5_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).groupBy(tx.content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1")


@query("select page_id, 'html' kind from pages")
def t4_content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.content_type(F.col("html")).alias("kind"))


@query(r"select doc_id, len(list_filter(list_transform(string_split_regex(text, '[.!?\n]'), lambda s: trim(s, ' ')), lambda s: length(s) > 0)) n, list_filter(list_transform(string_split_regex(text, '[.!?\n]'), lambda s: trim(s, ' ')), lambda s: length(s) > 20)[1:3] summary from documents")
def t9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("n"), F.slice(tx.sentences(F.col("text"), 20), 1, 3).alias("summary"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


@query(f"select doc_id, term, n, rank from (select *, row_number() over (partition by doc_id order by n desc, term) rank from (select doc_id, term, count(*) n from {_TOK} where length(term) >= 3 and term not in ({_STOP}) group by all)) where rank <= 5")
def t10_keyphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.keyphrases(docs_of(spark, sf_dir), "doc_id", "text")


# Reranking.


@query(r"""with w as (select doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> '')) s from documents),
j as (select doc_id, round(len(list_intersect(s, ['the', 'that', 'with', 'for'])) / len(list_distinct(list_concat(s, ['the', 'that', 'with', 'for'])))::double, 6) score from w)
select * from (select doc_id, score, row_number() over (order by score desc, doc_id) rank from j where score > 0) where rank <= 20""")
def r13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.lexical(docs_of(spark, sf_dir), "the that with for", 20)


def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeness of every document's word set, made once, to three questions; over 0 only."""
    docs = docs_of(spark, sf_dir).select("doc_id", "source", tx.word_set(F.col("text")).alias("own"))
    asked = spark.createDataFrame([("q1", "the that with for"), ("q2", "de la que les"), ("q3", "der die und nicht")], "query_id string, question string")
    score = tx.jaccard(F.col("own"), tx.word_set(F.col("question")))
    pairs = docs.join(F.broadcast(asked)).select("query_id", "question", "doc_id", F.col("source").alias("collection"), F.round(score, 6).alias("score"))
    return pairs.where("score > 0")


def lexical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of each question as hits of a search; texts join only these."""
    best = search.ranked(lexical_scores(spark, sf_dir), 50, key="doc_id", by=("query_id",)).drop("rank")
    return docs_of(spark, sf_dir).select("doc_id", F.col("text").alias("content")).join(F.broadcast(best), "doc_id")


@query()
def r1_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.mmr(lexical_hits(spark, sf_dir), 10)


@query()
def r3_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.distinct_enough(lexical_hits(spark, sf_dir))


_ASKED = r"(values ('q1', ['the', 'that', 'with', 'for']), ('q2', ['de', 'la', 'que', 'les']), ('q3', ['der', 'die', 'und', 'nicht'])) q(query_id, w)"
_HITS = rf"""s as (select doc_id, source, text, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> '')) s from documents),
h0 as (select query_id, doc_id, source collection, text as content, round(len(list_intersect(s, w)) / len(list_distinct(list_concat(s, w)))::double, 6) score from s, {_ASKED}),
h as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from h0 where score > 0) where rank <= 50)"""
_SENT = r"least(1.0::double, 0.5::double + case when len(list_filter(string_split_regex(content, '\s+'), lambda t: t <> '')) between 8 and 30 then 0.2::double else 0 end + case when regexp_matches(content, '^\p{Lu}') then 0.1::double else 0 end + case when regexp_matches(content, '[.!?]$') then 0.1::double else 0 end + case when regexp_matches(lower(content), 'is|provides|supports|enables|allows') then 0.1::double else 0 end)"


@query(f"with {_HITS} select query_id, doc_id, round(0.6::double * score + 0.2::double * (len(list_filter(['the', 'la', 'und'], lambda t: contains(lower(content), t))) / 3.0::double) + 0.1::double * {_SENT} + 0.1::double, 6) score from h")
def r4_focus_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(F.lit("the"), F.lit("la"), F.lit("und"))
    return lexical_hits(spark, sf_dir).select("query_id", "doc_id", F.round(rerank.focus_score(F.col("score"), F.col("content"), terms, F.lit(0)), 6).alias("score"))


@query(f"with {_HITS} select query_id, doc_id, round(score * case when contains(content, 'API') or contains(content, 'framework') or contains(content, 'implementation') then 1.1::double else 1 end * case when contains(lower(content), 'the') then 1.2::double else 1 end, 6) score from h")
def r5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_hits(spark, sf_dir).select("query_id", "doc_id", F.round(rerank.rule_score(F.col("score"), F.col("content"), "the"), 6).alias("score"))


@query("select * from (values (0, 'vector search engine'), (1, 'vector'), (2, 'search'), (3, 'engine'), (4, 'vector search'), (5, 'search engine')) t(n, query)")
def r6_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rerank.expand_words("vector search engine"))), "n int, query string")


@query("select * from (values (0, 'the vector store'), (1, 'vector definition'), (2, 'what is vector'), (3, 'vector features'), (4, 'vector capabilities'), (5, 'vector main functionality'), (6, 'vector architecture'), (7, 'vector components')) t(n, query)")
def r8_expand_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rerank.expand_templates("the vector store"))), "n int, query string")


@query(f"with {_HITS} select collection, max(score) best from h0 where score > 0 group by collection")
def r12_prioritise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.prioritised(lexical_scores(spark, sf_dir), ["src0", "src1"]).select("collection", "best")


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as collections, last changed as many days into 2024 as their number."""
    rows = docs_of(spark, sf_dir).groupBy(F.col("source").alias("name")).agg(F.count("*").alias("vector_count"), F.array_sort(F.collect_set("lang")).alias("tags"))
    return rows.withColumn("updated_at", F.date_add(F.to_date(F.lit("2024-01-01")), F.regexp_extract("name", r"(\d+)", 1).cast("int")))


@query("select distinct source as name from documents where contains(source, 'src1') and not source glob 'src1?'")
def r14_filter_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.filter_collections(collections(spark, sf_dir), "the src1", exclude=["src1?"]).select("name")


@query("""with c as (select source as name, count(*) n, regexp_extract(source, '(\\d+)', 1)::int d from documents group by source),
m as (select *, (contains(name, 'src1')::int + contains(name, 'en')::int) / 2.0::double * case when starts_with(name, 'src1') or starts_with(name, 'en') then 1.5::double else 1 end m,
len(list_filter(['docs', 'source', 'api', 'sdk', 'core'], lambda b: contains(name, b))) / 5.0::double b from c)
select name, round(0.4::double * least(1.0::double, m) + 0.3::double * b + 0.3::double * (least(1.0::double, n / 1e6::double) + exp(-(60 - d) / 90.0::double)) / 3, 6) score from m""")
def r15_score_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.to_date(F.lit("2024-03-01"))
    return discovery.score_collections(collections(spark, sf_dir), "src1 en", now).select("name", F.round("score", 6).alias("score"))


@query()
def r16_broad(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical_hits(spark, sf_dir).select(F.col("query_id").alias("question"), F.col("question").alias("query"), "collection", "doc_id", (F.col("score") * 20).alias("score"), "content")
    return discovery.broad(hits, 10).select("question", "doc_id", "score", "position")


@query(f"""with {_HITS}, z as (select query_id query, doc_id, round(0.6::double * score + 0.2::double * (len(list_filter(['the', 'la', 'und'], lambda t: contains(lower(content), t))) / 3.0::double) + 0.1::double * {_SENT} + 0.1::double, 6) score from h where rank <= 20 and score >= 0.01)
select * from (select query, doc_id, score, row_number() over (order by score desc, doc_id) rank from z) where rank <= 10""")
def r17_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical_hits(spark, sf_dir).withColumnRenamed("query_id", "query").withColumn("chunk_index", F.lit(0))
    return discovery.focus(hits, ["the", "la", "und"], 10, least=0.01).select("query", "doc_id", "score", "rank")


@query(f"""with {_HITS}, p as (select doc_id, 'docs/' || case when doc_id % 7 = 0 then 'README' else 'guide' end || doc_id || '.md' file_path, score from h where query_id = 'q1'), rs as (select doc_id, round(score * case when doc_id % 7 = 0 then 1.5 else 1 end, 6) score, doc_id % 7 = 0 readme from p)
select doc_id, score, readme, (row_number() over (order by readme desc, score desc, doc_id))::int as position from rs""")
def r18_promote_readme(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("docs/"), F.when(F.col("doc_id") % 7 == 0, "README").otherwise("guide"), "doc_id", F.lit(".md"))
    out = discovery.promote_readme(lexical_hits(spark, sf_dir).where("query_id = 'q1'").withColumn("file_path", path))
    return out.select("doc_id", F.round("score", 6).alias("score"), "readme", "position")


def bullets_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.compress(lexical_hits(spark, sf_dir).where("query_id = 'q1'"), "doc_id", "content")


@query()
def r19_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bullets_of(spark, sf_dir)


@query()
def r21_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.answer_plan(bullets_of(spark, sf_dir))


@query()
def r22_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last steps of a discovery: compression, plan and prompt."""
    return discovery.prompt(discovery.answer_plan(bullets_of(spark, sf_dir)), "the that with for")


@query(f"with {_HITS} select query_id, doc_id, case when len(c) > 0 then array_to_string(c[1:3], chr(10)) else substr(content, 1, 500) end as context from (select *, list_filter(string_split(content, chr(10)), lambda x: contains(lower(x), 'nicht') or contains(lower(x), 'los')) c from h)")
def r24_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.context(lexical_hits(spark, sf_dir), "the nicht los").select("query_id", "doc_id", "context")


@query()
def r26_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical_hits(spark, sf_dir)
    return rerank.strategies([hits.where("query_id = 'q1'"), hits.where("query_id = 'q2'"), hits.where("query_id = 'q3'")], 10, least=0.0)


# Evaluation.


_CURVE = f"""r as ({_BATCH}), t as (select q.vec_id query_id, e.vec_id from embeddings q join embeddings e on q.label = e.label and q.vec_id <> e.vec_id and q.vec_id % 50 = 0), z as (select query_id, count(*) relevant from t group by query_id),
m as (select r.query_id, r.vec_id, rank, case when t.vec_id is null then 0 else 1 end hit, relevant from r left join t on t.query_id = r.query_id and t.vec_id = r.vec_id left join z on z.query_id = r.query_id),
c as (select *, sum(hit) over (partition by query_id order by rank) hits, sum(hit) over (partition by query_id order by rank) / rank::double p from m)"""


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    asked = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))
    return evaluate.label_curves(search.batch_knn(emb, asked, 10), emb, key="vec_id")


@query(f"with {_CURVE} select query_id, rank, hit, hits::bigint hits, round(p, 6) precision_at_k, round(coalesce(last_value(case when hit = 1 then p end ignore nulls) over (partition by query_id order by rank), 0), 6) curve, round(hits / relevant::double, 6) recall from c")
def a2_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return evaluated(spark, sf_dir).select("query_id", "rank", "hit", F.col("hits").cast("long").alias("hits"), r("precision_at_k"), r("curve"), r("recall"))


@query(f"with {_CURVE}, q as (select query_id, coalesce(sum(p) filter (where hit = 1) / max(relevant), 0) ap, coalesce(1.0::double / min(rank) filter (where hit = 1), 0) rr from c group by query_id) select round(avg(ap), 6) as map, round(avg(rr), 6) mrr, count(*) queries from q")
def a3_map_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.overall(evaluate.by_query(evaluated(spark, sf_dir))).select(F.round("map", 6).alias("map"), F.round("mrr", 6).alias("mrr"), "queries")


# Files.


@query("select count(*) vectors, count(distinct label) labels, 64 as dimension, count(*) * 64 * 4 as bytes from embeddings")
def a4_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.agg(F.count("*").alias("vectors"), F.countDistinct("label").alias("labels"), F.max(F.size("embedding")).alias("dimension"), F.sum(F.size("embedding").cast("long") * 4).alias("bytes"))


_FILES = "(select source || '/' || doc_id || '.' || lang path, doc_id, text as content from documents)"


def one_chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select(F.concat_ws("", "source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("path"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"))


@query(f"select path, count(*) chunks, round(sum(strlen(content)) / 1024.0::double, 6) size_kb from {_FILES} group by path order by size_kb desc, path limit 30")
def a5_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.list_files(one_chunk_files(spark, sf_dir), "size", 30).withColumn("size_kb", F.round("size_kb", 6))


@query()
def a6_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of files rebuilt from their chunks (the longest overlap is taken once)."""
    back = files.contents(chunked(spark, sf_dir))
    return back.select("path", F.length(F.regexp_replace("content", r"\s+", "")).cast("long").alias("letters"))


@query()
def a7_neighbour_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.ordered_chunks(chunked(spark, sf_dir)).select("path", "chunk_index", "before", "after")


@query("select source as folder, lang as extension, count(*) files, count(*) chunks from documents group by all")
def a8_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.outline(one_chunk_files(spark, sf_dir))


@query(f"with {_HITS} select collection as path, round(avg(score), 6) score, count(*) chunks from h where collection <> 'src0' group by 1 having round(avg(score), 6) >= 0.01 order by 2 desc, 1 limit 8")
def a9_related_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.related_files(lexical_hits(spark, sf_dir).withColumnRenamed("collection", "path"), "src0", 0.01, 8)


@query(r"select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^#{1,6} '))[1:10] headings, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*[-*] '))[1:10] points from documents")
def a11_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.structural(docs_of(spark, sf_dir), "doc_id", "text")


@query(f"select doc_id, term, n, rank from (select *, row_number() over (partition by doc_id order by n desc, term) rank from (select doc_id, term, count(*) n from {_TOK} where length(term) >= 4 group by all)) where rank <= 10")
def a13_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.keyword_summary(docs_of(spark, sf_dir), "doc_id", "text")


@query("select user_id, count(*) used, count(*) + 10 <= 80 allowed, greatest(80 - count(*), 0)::bigint as left from events group by user_id".replace("as left", 'as "left"'))
def a14_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("used")).withColumn("asked", F.lit(10))
    return files.quota(used, 80).drop("asked")


@query("select event_id, value from events where value >= 90 order by value desc, event_id limit 20")
def a15_slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value >= 90").orderBy(F.desc("value"), "event_id").limit(20).select("event_id", "value")


# Graphs.


_EDGES = f"(select query_id source, vec_id target, score weight from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from (select q.vec_id query_id, e.vec_id, round({_COS}, 6) score from embeddings e join embeddings q on q.vec_id <> e.vec_id)) where rank <= 20 and score >= 0.3 qualify row_number() over (partition by query_id order by rank) <= 10)"


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return cut(graph.similar_edges(emb, queries_of(emb, "true"), 0.3), "edges")


@query(f"select source, target, weight from {_EDGES}")
def g6_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(spark, sf_dir).select("source", "target", "weight")


@query(f"select target as node, weight from {_EDGES} where source = 5")
def g2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(edges_of(spark, sf_dir), 5, "SIMILAR_TO").select("node", "weight")


@query(f"""with recursive e as materialized {_EDGES}, h1 as (select target node, max(weight) w from e where source = 5 and target <> 5 group by 1), h2 as (select e.target node, max(w * weight) w from h1 join e on e.source = h1.node where e.target <> 5 and e.target not in (select node from h1) group by 1)
select node, 1 as hop, round(w, 6) weight from h1 union all select node, 2, round(w, 6) from h2""")
def g3_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(edges_of(spark, sf_dir), 5, 2).select("node", "hop", F.round("weight", 6).alias("weight"))


@query()
def g4_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edges_of(spark, sf_dir)
    far = graph.related(edges, 5, 3).orderBy(F.desc("hop"), "node").first()
    length = graph.shortest_path_length(edges, 5, far["node"]) if far else None
    return spark.createDataFrame([(5, far["node"] if far else None, length)], "source long, target long, hops int")


@query()
def g5_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers that orders connect."""
    lines = table(spark, sf_dir, "lineitem")
    return graph.connected(lines.select(F.col("l_partkey").alias("source"), (F.col("l_suppkey") + 1000000).alias("target")).distinct())


@query("select n_name as source, r_name as target, 1.0::double as weight from nation join region on r_regionkey = n_regionkey")
def g7_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    own = nation.select(F.col("n_name").alias("id"), F.to_json(F.struct(F.array(F.concat(F.lit("region/"), F.col("n_regionkey").cast("string"))).alias("references"))).alias("payload"))
    other = region.select(F.col("r_name").alias("id"), F.to_json(F.struct(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("file_path"))).alias("payload"))
    return graph.reference_edges(own.unionByName(other), "references", "REFERENCES")[0].select("source", "target", "weight")


# Changes.


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == F.lit("purchase"), "delete").otherwise("upsert")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("op"), F.col("user_id").alias("id"), "value")


@query("select user_id id, event_id seq, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def m1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_of(spark, sf_dir).select("id", "seq", "value")
    return dml.upsert(rows.where("seq < 1000").transform(lambda d: dml.upsert(d.limit(0), d)), rows.where("seq >= 1000"))


@query("select event_id seq, user_id id, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1 and event_type <> 'purchase'")
def w4_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.replay(log_of(spark, sf_dir), after=-1)


@query("select c_custkey, c_acctbal from customer where c_custkey > 100 and not (c_custkey between 200 and 300)")
def m2_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    left, _ = dml.delete(c, c.where("c_custkey <= 100").select("c_custkey"), "c_custkey")
    return dml.delete_where(left, F.col("c_custkey").between(200, 300))


@query("select c_custkey, case when c_custkey <= 50 then 0 else c_acctbal end as c_acctbal from customer")
def m2_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    change = spark.range(-5, 51).select(F.col("id").alias("c_custkey"), F.lit(0.0).alias("c_acctbal"))
    return dml.update(c, change, "c_custkey")[0]


@query("select 'source' side, c_custkey from customer where c_nationkey = 3 and c_custkey % 2 = 1 union all select 'target', c_custkey from customer where c_nationkey = 4 or c_nationkey = 3 and c_custkey % 2 = 0")
def m6_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    a, b = dml.move(c.where("c_nationkey = 3"), c.where("c_nationkey = 4"), c.where("c_custkey % 2 = 0").select("c_custkey"), "c_custkey")
    return a.select(F.lit("source").alias("side"), "c_custkey").unionByName(b.select(F.lit("target").alias("side"), "c_custkey"))


@query("select event_id, '{\"k\":\"' || (props::json->>'k') || '\",\"type\":\"' || event_type || '\"}' payload from events")
def d19_set_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", dml.set_payload(F.col("props"), F.to_json(F.struct(F.col("event_type").alias("type")))).alias("payload"))


@query("select event_id, '{\"new\":' || user_id || '}' payload from events")
def m8_merge_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = F.concat(F.lit('{"k":null,"new":'), F.col("user_id").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", dml.merge_patch(F.col("props"), patch).alias("payload"))


@query("select event_id from events where epoch_ms(ts) + (value * 1000)::bigint > epoch_ms(timestamp '2024-01-15')")
def m9_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("expires_at", F.unix_millis(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1000).cast("long"))
    return dml.unexpired(e, 1705276800000).select("event_id")


@query("select event_type, window_start, count(*) n, round(sum(value), 4) total from (select event_type, time_bucket(interval '1 hour', ts) window_start, value from events) group by all")
def w8_usage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("window_start"), "n", "total")

