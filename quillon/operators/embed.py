"""Text embeddings as sparse (doc, term, weight) rows: BM25, TF-IDF, bag of words, n-grams, projections.

Vocabularies are the ``dim`` most frequent terms and so of bounded size; they are broadcast.
A document is one row, so its terms are counted, weighed and scaled where it is read, and only
counts by term are shuffled; rows that repeat a key are counted together by a shuffle of their own.
Nothing is densified unless asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import BLANK, CORE, char_ngrams, tokens

K1, B = 1.5, 0.75


PIECE = 1 << 21  # terms or characters counted at a time


@dataclass
class Words:
    """Terms as a list column."""

    of: Callable[[Column], Column] = tokens

    def column(self, text: Column) -> Column:
        return self.of(text)

    def exploded(self, text: Column) -> Column:
        return self.of(text)

    def sizes(self, column: pa.Array) -> np.ndarray:
        return column.value_lengths().to_numpy(zero_copy_only=False)

    def coded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable]:
        """The row and a number of each term, and what the numbers stand for."""
        found = column.flatten().dictionary_encode()
        return np.repeat(np.arange(len(column)), self.sizes(column)), found.indices.to_numpy(zero_copy_only=False), lambda codes: found.dictionary.take(pa.array(codes)).to_pylist()

    def places(self, column: pa.Array, vocabulary: dict) -> tuple[np.ndarray, np.ndarray]:
        """The row of each term and its place in the vocabulary, or -1."""
        found = column.flatten().dictionary_encode()
        place = np.array([vocabulary.get(w, -1) for w in found.dictionary.to_pylist()], np.int64)
        return np.repeat(np.arange(len(column)), self.sizes(column)), place[found.indices.to_numpy(zero_copy_only=False)] if len(place) else np.zeros(0, np.int64)


@dataclass
class Grams:
    """Windows of up to three characters of the lower-cased text; a shorter text is its own."""

    n: int = 3

    def column(self, text: Column) -> Column:
        return F.lower(text)

    def exploded(self, text: Column) -> Column:
        return char_ngrams(text, self.n)

    def sizes(self, column: pa.Array) -> np.ndarray:
        return np.array([max(1, len(t) - self.n + 1) for t in column.to_pylist()], np.int64)

    def coded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable]:
        """Characters, counted from 1, in 21 bits each; 0 where a short text has none."""
        texts = column.to_pylist()
        filled = [t if len(t) >= self.n else t.ljust(self.n, "\0") for t in texts]
        chars = np.frombuffer("".join(filled).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
        lengths = np.array([len(t) for t in filled], np.int64)
        starts = np.cumsum(lengths) - lengths
        for i in [i for i, t in enumerate(texts) if len(t) < self.n]:
            chars[starts[i] + len(texts[i]) : starts[i] + self.n] = 0
        rows, total = np.repeat(np.arange(len(texts)), lengths), len(chars) - self.n + 1
        codes = np.zeros(max(total, 0), np.int64)
        for d in range(self.n):
            codes = (codes << 21) | chars[d : d + total]
        whole = rows[: len(codes)] == rows[self.n - 1 :]
        return rows[: len(codes)][whole], codes[whole], lambda found: [self.term(int(c)) for c in found]

    def term(self, code: int) -> str:
        return "".join(chr(c - 1) for d in range(self.n - 1, -1, -1) if (c := code >> 21 * d & (1 << 21) - 1))

    def code(self, term: str) -> int:
        out = 0
        for d in range(self.n):
            out = out << 21 | (ord(term[d]) + 1 if d < len(term) else 0)
        return out

    def places(self, column: pa.Array, vocabulary: dict) -> tuple[np.ndarray, np.ndarray]:
        rows, codes, _ = self.coded(column)
        known = sorted((self.code(w), i) for w, i in vocabulary.items())
        at, place = (np.array([k[i] for k in known], np.int64) for i in (0, 1))
        if not len(at):
            return rows, np.full(len(rows), -1)
        near = np.minimum(np.searchsorted(at, codes), len(at) - 1)
        return rows, np.where(at[near] == codes, place[near], -1)


def _pieces(batches: Iterator[pa.RecordBatch], kind: Words | Grams) -> Iterator[pa.RecordBatch]:
    """Batches without rows that have no text, cut where they hold too much to count at once."""
    for batch in batches:
        batch = batch.filter(batch.column(1).is_valid())
        start, sizes = 0, np.cumsum(kind.sizes(batch.column(1)))
        while start < len(batch):
            end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + PIECE)))
            yield batch.slice(start, end - start)
            start = end


def term_totals(docs: DataFrame, key: str, text: str, kind: Words | Grams, frequency: bool = True) -> DataFrame:
    """term, n and, with ``frequency``, df: counted batch by batch, then added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, kind):
            rows, codes, names = kind.coded(batch.column(1))
            if frequency:
                found, codes, n = np.unique(codes, return_inverse=True, return_counts=True)
                df = np.bincount(np.unique(rows * max(1, len(found)) + codes) % max(1, len(found)), minlength=len(found))
            else:
                found, n = np.unique(codes, return_counts=True)
                df = np.zeros(len(found), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names(found), pa.string()), pa.array(n, pa.int64()), pa.array(df, pa.int64())], names=["term", "n", "df"])

    parts = docs.select(key, kind.column(F.col(text)).alias("t")).mapInArrow(count, "term string, n long, df long")
    return parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def term_weights(docs: DataFrame, key: str, text: str, kind: Words | Grams, vocabulary: dict[str, float], weigh: Callable, unit: bool) -> DataFrame:
    """key, term, weight of the vocabulary's terms: ``weigh`` of their counts, their document's length and
    the vocabulary's value; ``unit`` divides by the document's norm."""
    names, place = list(vocabulary), {w: i for i, w in enumerate(vocabulary)}
    values, dim = np.array(list(vocabulary.values()), np.float64), max(1, len(vocabulary))
    fields = docs.select(key).schema

    def scaled(row: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        return weight / np.sqrt(np.bincount(row, weight * weight, n))[row] if unit else weight

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(names, pa.string())
        for batch in _pieces(batches, kind):
            rows, at = kind.places(batch.column(1), place)
            pair, tf = np.unique((rows * dim + at)[at >= 0], return_counts=True)
            row, at = pair // dim, pair % dim
            weight = scaled(row, weigh(tf.astype(np.float64), kind.sizes(batch.column(1))[row], values[at]), len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), terms.take(pa.array(at)), pa.array(weight)], names=[key, "term", "weight"])

    def group(table: pa.Table) -> pa.Table:
        at = np.array([place[w] for w in table["term"].to_pylist()], np.int64)
        weight = weigh(table["tf"].to_numpy().astype(np.float64), table["len"].to_numpy(), values[at])
        weight = scaled(np.zeros(len(at), np.int64), weight, 1)
        return pa.table([table[key], table["term"], pa.array(weight)], names=[key, "term", "weight"])

    schema = fields.add("term", "string").add("weight", "double")
    repeated = docs.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(F.col(key).alias("__key"))
    if not repeated.take(1):
        return docs.select(key, kind.column(F.col(text)).alias("t")).mapInArrow(count, schema)
    same = F.col(key).eqNullSafe(F.col("__key"))
    once = docs.join(repeated, same, "left_anti").select(key, kind.column(F.col(text)).alias("t")).mapInArrow(count, schema)
    known = F.array(*map(F.lit, names)).cast("array<string>")
    each = docs.join(repeated, same, "left_semi").select(key, F.explode(kind.exploded(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    each = each.withColumn("len", F.sum("tf").over(Window.partitionBy(key))).where(F.array_contains(known, F.col("term")))
    return once.unionByName(each.groupBy(key).applyInArrow(group, schema))


def top_terms(totals: DataFrame, dim: int, by: Column | None = None) -> DataFrame:
    """term, n, df and index of the ``dim`` terms that occur most; ties by term."""
    order = [F.desc("n") if by is None else by.desc(), "term"]
    return totals.orderBy(*order).limit(dim).withColumn("index", F.row_number().over(Window.orderBy(*order)) - 1)


def plain_counts(tf: np.ndarray, length: np.ndarray, value: np.ndarray) -> np.ndarray:
    return tf


@dataclass
class BM25:
    """A fitted vocabulary: terms with df and idf, the number of documents and their mean length."""

    vocabulary: DataFrame
    documents: int
    mean_length: float

    @staticmethod
    def fit(docs: DataFrame, key: str, text: str, dim: int = 512) -> BM25:
        totals = term_totals(docs, key, text, Words())
        sizes = docs.select(F.size(tokens(F.col(text))).alias("n")).agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
        idf = F.log((sizes["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        return BM25(top_terms(totals, dim).withColumn("idf", idf), sizes["n"], sizes["mean"] or 0.0)

    def weights(self, docs: DataFrame, key: str, text: str, unit: bool = False) -> DataFrame:
        """key, term, weight; ``unit`` divides by the document's norm."""
        mean = self.mean_length
        weigh = lambda tf, length, idf: idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        return term_weights(docs, key, text, Words(), values_of(self.vocabulary, "idf"), weigh, unit)


def values_of(vocabulary: DataFrame, value: str) -> dict[str, float]:
    """A vocabulary of ``dim`` terms at most, for broadcasting."""
    return {r["term"]: float(r[value]) for r in vocabulary.select("term", value).collect()}


def tfidf(docs: DataFrame, key: str, text: str, dim: int = 512) -> DataFrame:
    """Unit rows of count / total * max(0, ln(N / df)); tokens of more than two bytes before trimming."""
    pieces = lambda t: F.filter(F.split(F.lower(t), f"[{BLANK}]+"), lambda x: F.octet_length(x) > 2)
    long = lambda t: F.filter(F.transform(pieces(t), lambda x: F.regexp_extract(x, CORE, 0)), lambda x: x != "")
    n = docs.count()
    idf = F.greatest(F.lit(0.0), F.log(F.lit(float(n)) / F.col("df")))
    vocabulary = top_terms(term_totals(docs, key, text, Words(long)), dim, F.round(F.col("n") * idf, 9)).withColumn("idf", idf).where("idf > 0")
    return term_weights(docs, key, text, Words(long), values_of(vocabulary, "idf"), lambda tf, length, idf: tf / length * idf, unit=True)


def bag_of_words(docs: DataFrame, key: str, text: str, dim: int = 512) -> DataFrame:
    vocabulary = values_of(top_terms(term_totals(docs, key, text, Words()), dim), "n")
    return term_weights(docs, key, text, Words(), vocabulary, plain_counts, unit=True)


def char_gram_counts(docs: DataFrame, key: str, text: str, n: int = 3, dim: int = 512) -> DataFrame:
    kind = Grams(n) if n <= 3 else Words(lambda t: char_ngrams(t, n))  # a number holds three characters
    vocabulary = values_of(top_terms(term_totals(docs, key, text, kind, frequency=False), dim), "n")
    return term_weights(docs, key, text, kind, vocabulary, plain_counts, unit=True)


def projected(rows: DataFrame, key: str, dim: int = 16, seed: int = 42) -> DataFrame:
    """A random projection of sparse rows: component d is the sum of weights times a hashed normal number."""
    u = lambda salt: (F.pmod(F.xxhash64("term", F.lit(seed), F.lit(salt), "d"), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))
    each = rows.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(dim - 1)))).groupBy(key, "d").agg(F.sum(F.col("weight") * normal).alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"] / F.sqrt(F.lit(float(dim)))).alias("vector"))


def hash_vector(text: Column, dim: int) -> Column:
    """A deterministic stand-in where no vocabulary term is found; values are this library's own."""
    x = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.pmod(F.xxhash64(text, i), F.lit(1 << 30)) / F.lit(float(1 << 29)) - 1)
    n = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(x, lambda v: v / n)


def retrieve(rows: DataFrame, query: DataFrame, key: str) -> DataFrame:
    """Cosine of unit rows with a query's (term, weight) rows, by a join on terms."""
    return rows.join(F.broadcast(query.select("term", F.col("weight").alias("q"))), "term").groupBy(key).agg(F.sum(F.col("weight") * F.col("q")).alias("score"))


@dataclass
class Registry:
    """Providers by name, one of them the default."""

    providers: dict[str, Callable] = field(default_factory=dict)
    default: str | None = None

    def register(self, name: str, provider: Callable) -> None:
        self.providers[name] = provider
        self.default = self.default or name

    def get(self, name: str | None = None) -> Callable:
        if (name or self.default) not in self.providers:
            raise KeyError(f"no embedding provider {name or self.default}")
        return self.providers[name or self.default]
