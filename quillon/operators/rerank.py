"""Reranking, diversifying and expanding: what happens to candidates between search and answer.

Greedy steps are sequential within one query, so they run as one pandas group for each query
over at most ``most`` candidates: the ranked head of its search, a documented bound and the
feature itself (a top-k).  Queries are spread over tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import STOPWORDS, jaccard, sentence_quality, term_frequency, word_set
from quillon.operators.search import ranked


def word_jaccard(a: set, b: set, both_empty: float = 0.0) -> float:
    return len(a & b) / len(a | b) if a or b else both_empty


def _candidates(df: DataFrame, by: str, key: str, most: int) -> DataFrame:
    return ranked(df, most, key=key, by=(by,), as_rank="__rank").drop("__rank")


def mmr(df: DataFrame, k: int, trade: float = 0.7, by: str = "query_id", key: str = "doc_id", text: str = "content", seed: str = "best", most: int = 500) -> DataFrame:
    """Maximal marginal relevance: the best first, then the largest trade * score - (1 - trade) *
    likeness to what is taken (word-set Jaccard); ties to the smaller key.  ``seed="last"``
    starts with the last candidate instead."""
    rows = _candidates(df.select(by, key, "score", text), by, key, most)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", key], ascending=[False, True]).reset_index(drop=True)
        sets = [set((t or "").lower().split()) for t in pdf[text]]
        left = list(range(len(pdf)))
        taken = [left.pop(-1 if seed == "last" else 0)] if left else []
        near = [word_jaccard(sets[i], sets[taken[0]]) for i in range(len(sets))] if taken else []
        while left and len(taken) < k:
            best = max(left, key=lambda i: (trade * pdf["score"][i] - (1 - trade) * near[i], -i))
            left.remove(best)
            taken.append(best)
            near = [max(n, word_jaccard(sets[i], sets[best])) for i, n in enumerate(near)]
        out = pdf.iloc[taken].copy()
        out["position"] = range(1, len(out) + 1)
        return out[[by, key, "score", "position"]]

    kinds = dict(rows.dtypes)
    return rows.groupBy(by).applyInPandas(pick, f"{by} {kinds[by]}, {key} {kinds[key]}, score double, position int")


def distinct_enough(df: DataFrame, most_alike: float = 0.8, by: str = "query_id", key: str = "doc_id", text: str = "content", keep_better: bool = False, most: int = 500) -> DataFrame:
    """Candidates, best first, without those more alike to a kept one than ``most_alike``;
    ``keep_better`` compares words as written and calls two empty texts alike."""
    rows = _candidates(df.select(by, key, "score", text), by, key, most)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", key], ascending=[False, True])
        kept: list[set] = []
        rows = []
        for i, t in enumerate(pdf[text]):
            own = set((t or "").split()) if keep_better else set((t or "").lower().split())
            if all(word_jaccard(own, other, float(keep_better)) <= most_alike for other in kept):
                kept.append(own)
                rows.append(i)
        return pdf.iloc[rows][[by, key, "score"]]

    kinds = dict(rows.dtypes)
    return rows.groupBy(by).applyInPandas(keep, f"{by} {kinds[by]}, {key} {kinds[key]}, score double")


def focus_score(score: Column, content: Column, terms: Column, chunk_index: Column) -> Column:
    """0.6 of the score, 0.2 of the terms found, 0.1 of sentence quality, 0.1 of an early chunk."""
    return 0.6 * score + 0.2 * term_frequency(content, terms) + 0.1 * sentence_quality(content) + 0.1 / (1 + 0.1 * chunk_index)


def rule_score(score: Column, content: Column, query: str, context: bool = False) -> Column:
    """More for technical words (1.1) and for the query itself in the text (1.2), in context another 1.05."""
    technical = F.when(content.contains("API") | content.contains("framework") | content.contains("implementation"), 1.1).otherwise(1.0)
    quoted = F.when(F.lower(content).contains(query.lower()), 1.2).otherwise(1.0)
    return score * technical * quoted * (1.05 if context else 1.0)


def lexical(df: DataFrame, query: str, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ranking by word-set Jaccard with the query; no common word, no result."""
    scored = df.select(key, F.round(jaccard(word_set(F.col(text)), F.array_distinct(F.array(*map(F.lit, query.lower().split())))), 6).alias("score"))
    return ranked(scored.where("score > 0"), k, key=key)


def topic_words(query: str) -> list[str]:
    return [w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split() if w not in STOPWORDS]


#: What a query that contains a name is also asked as.
SYNONYMS = {"cmmv": ("Contract Model View framework", "TypeScript framework"), "api": ("application programming interface", "REST API")}


def expand_words(query: str) -> list[str]:
    """The query, its words of more than three bytes, its bigrams, and synonyms of names in it."""
    words = query.split()
    out = [query, *(w for w in words if len(w.encode()) > 3), *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]
    return out + [s for name, more in SYNONYMS.items() if name in query.lower() for s in more]


#: Ways to ask about a topic, and words that are none.
TEMPLATES = (
    "{} definition", "what is {}", "{} features", "{} capabilities", "{} main functionality", "{} architecture", "{} components",
    "{} system design", "{} API", "{} usage", "{} performance", "{} benchmarks", "{} use cases", "{} examples",
)
NO_TOPIC = ("o", "que", "é", "the", "is", "a", "what", "how", "de", "da", "do")


def expand_templates(query: str, most: int = 8) -> list[str]:
    topic = next((w for w in query.split() if w.lower() not in NO_TOPIC), query)
    return [query, *(t.format(topic) for t in TEMPLATES)][:most]


def prioritised(tops: DataFrame, names: list[str], least: float = -0.5) -> DataFrame:
    """Collections by their best score, then those without one over ``least`` in the given order."""
    given = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))))
    best = tops.groupBy("collection").agg(F.max("score").alias("best"))
    return best.withColumn("found", F.col("best") > least).withColumn("place", F.try_element_at(given, F.col("collection"))).orderBy(F.desc("found"), F.when(F.col("found"), -F.col("best")), "place")


def strategies(results: list[DataFrame], k: int, key: str = "doc_id", least: float = 0.1) -> DataFrame:
    """Results of several strategies: the first to return an id decides its score; twice k at most."""
    from functools import reduce

    from pyspark.sql import Window

    every = reduce(DataFrame.unionByName, [r.select(key, "score").withColumn("strategy", F.lit(i)) for i, r in enumerate(results)])
    first = every.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("strategy", F.desc("score")))).where("n = 1").drop("n")
    return ranked(first.where(F.col("score") >= least), 2 * k, key=key)
