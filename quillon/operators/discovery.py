"""Evidence discovery: collections are filtered and scored, searched broadly, focused, compressed
to bullets and planned into a prompt.  Every step is a DataFrame; queries and collections are
rows, so the loops of a step are one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.predicates import glob
from quillon.functions.text import STOPWORDS, marked_sentences, tokens, words
from quillon.operators.rerank import distinct_enough, focus_score, mmr, topic_words
from quillon.operators.search import ranked


def filter_collections(collections: DataFrame, query: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """By name patterns, and, if the query has topic words, names that contain one."""
    rows = collections.where(glob(F.col("name"), list(include), list(exclude)))
    topics = topic_words(query)
    some = F.lit(not topics)
    for t in topics:
        some |= F.lower("name").contains(t)
    return rows.where(some)


#: What a collection's name, and what its tags, score for.
BOOSTED = ("docs", "source", "api", "sdk", "core")
TAGS = ("documentation", "code", "api")


def score_collections(collections: DataFrame, query: str, now: Column) -> DataFrame:
    """0.4 name match (half as much again where the name starts with a term), 0.3 boosted names,
    0.3 the mean of size (of a million), recency and tags."""
    terms = query.lower().split()
    name = F.lower("name")
    share = lambda marks: sum((F.when(name.contains(m), 1.0).otherwise(0.0) for m in marks), F.lit(0.0)) / max(1, len(marks))
    starts = F.lit(False)
    for t in terms:
        starts |= name.startswith(t)
    match = F.least(F.lit(1.0), share(terms) * F.when(starts, 1.5).otherwise(1.0))
    size = F.least(F.lit(1.0), F.col("vector_count") / 1e6)
    recent = F.exp(-F.datediff(now, F.col("updated_at")) / 90.0)
    tags = F.coalesce(F.size(F.filter("tags", lambda t: t.isin(*TAGS))), F.lit(0)) / float(len(TAGS))
    return collections.withColumn("score", 0.4 * match + 0.3 * share(BOOSTED) + 0.3 * (size + recent + tags) / 3)


def broad(hits: DataFrame, k: int, least: float = 0.3, alike: float = 0.85, trade: float = 0.7, per: int = 10, text: str = "content", key: str = "doc_id") -> DataFrame:
    """``hits`` (question, query, collection, key, score, text): the best of each query and
    collection over ``least``, near copies dropped, diversified to k a question."""
    top = ranked(hits, per, key=key, by=("question", "query", "collection")).where(F.col("score") >= least)
    once = top.groupBy("question", key).agg(F.max("score").alias("score"), F.first(text).alias(text))
    kept = distinct_enough(once, alike, "question", key, text, keep_better=True)
    kept = kept.join(once.select("question", key, text), ["question", key])
    return mmr(kept, k, trade, "question", key, text).join(once.select("question", key, text), ["question", key])


def focus(hits: DataFrame, terms: list[str], k: int, least: float = 0.35, text: str = "content", key: str = "doc_id") -> DataFrame:
    """The best 2k of each query over ``least``, rescored by content, the k best; of equal score and
    key, what ranked higher in its own query."""
    top = ranked(hits, 2 * k, key=key, by=("query",), as_rank="own_rank").where(F.col("score") >= least)
    value = focus_score(F.col("score"), F.col(text), F.array(*map(F.lit, terms)), F.col("chunk_index"))
    return ranked(top.withColumn("score", F.round(value, 6)), k, key=key, then=("own_rank", "query")).drop("own_rank")


def promote_readme(hits: DataFrame, path: str = "file_path", key: str = "doc_id", by: float = 1.5) -> DataFrame:
    """Readme files score more and come first."""
    readme = F.lower(F.element_at(F.split(F.col(path), "/"), -1)).startswith("readme")
    out = hits.withColumn("readme", readme).withColumn("score", F.col("score") * F.when(readme, by).otherwise(1.0))
    return out.withColumn("position", F.row_number().over(Window.orderBy(F.desc("readme"), F.desc("score"), key)))


def keyphrases(docs: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """The n most frequent tokens of three letters or more that are no stopwords; ties by term."""
    each = docs.select(key, F.explode(tokens(F.col(text))).alias("term")).where((F.length("term") >= 3) & ~F.col("term").isin(*STOPWORDS))
    best = Window.partitionBy(key).orderBy(F.desc("n"), "term")
    return each.groupBy(key, "term").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def compress(docs: DataFrame, key: str, text: str, per: int = 3, bullets: int = 20, least: int = 8, most: int = 30) -> DataFrame:
    """Bullets: the sentences of 8 to 30 words densest in the document's ten keyphrases, with the document's score."""
    phrases = keyphrases(docs, key, text, 10).groupBy(key).agg(F.collect_list("term").alias("phrases"))
    each = docs.select(key, "score", F.posexplode(marked_sentences(F.col(text))).alias("place", "sentence"))
    each = each.where(F.size(words(F.col("sentence"))).between(least, most)).join(phrases, key)
    low = F.lower("sentence")
    density = F.size(F.filter("phrases", lambda p: F.contains(low, p))) / F.size(words(F.col("sentence")))
    own = Window.partitionBy(key).orderBy(F.desc("density"), "place")
    top = each.withColumn("density", F.round(density, 6)).withColumn("n", F.row_number().over(own)).where(F.col("n") <= per)
    return top.withColumn("bullet_score", F.round("score", 6)).orderBy(F.desc("bullet_score"), key, F.desc("density"), "place").limit(bullets).select(key, "place", "sentence", "density", "bullet_score", category(F.col("sentence")).alias("category"))


#: The first class with one of its words wins.
CATEGORIES = (
    ("definition", ("is a", "defines", "represents")),
    ("feature", ("feature", "support", "provides")),
    ("architecture", ("architecture", "component", "module")),
    ("performance", ("performance", "speed", "latency")),
    ("integration", ("integration", "api", "sdk")),
    ("use_case", ("use case", "example", "application")),
)


def category(sentence: Column) -> Column:
    low = F.lower(sentence)
    out = F.lit("other")
    for name, marks in reversed(CATEGORIES):
        some = F.lit(False)
        for m in marks:
            some |= low.contains(m)
        out = F.when(some, name).otherwise(out)
    return out


def answer_plan(bullets: DataFrame, per: int = 5, key: str = "doc_id") -> DataFrame:
    """The best bullets of each section."""
    best = Window.partitionBy("category").orderBy(F.desc("bullet_score"), key, "place")
    return bullets.withColumn("n", F.row_number().over(best)).where(F.col("n") <= per)


def prompt(plan: DataFrame, question: str, tokens_at_most: int = 2000, key: str = "doc_id") -> DataFrame:
    """One text with a section for each category, bullets cited by id, cut to four characters a token.
    A plan holds a few bullets a section, so one row is built of a bounded number."""
    line = F.concat(F.lit("- "), F.col("sentence"), F.lit(" ["), F.col(key).cast("string"), F.lit("]"))
    sections = plan.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "lines"))), lambda s: F.concat(F.lit("## "), s["category"], F.lit("\n"), s["lines"])), "\n\n")
    return sections.agg(text.alias("t")).select(F.substring(F.concat(F.lit(f"Question: {question}\n\n"), F.coalesce("t", F.lit(""))), 1, 4 * tokens_at_most).alias("prompt"))


def context(hits: DataFrame, query: str, text: str = "content", lines: int = 3, chars: int = 500) -> DataFrame:
    """Each hit as a header and its first lines with a query word, or its first 500 characters."""
    topics = topic_words(query)
    has = lambda line: F.exists(F.array(*map(F.lit, topics)), lambda t: F.contains(F.lower(line), t)) if topics else F.lit(False)
    found = F.slice(F.filter(F.split(F.col(text), "\n"), has), 1, lines)
    return hits.withColumn("context", F.when(F.size(found) > 0, F.array_join(found, "\n")).otherwise(F.substring(F.col(text), 1, chars)))
