"""Quality classifier: supervised subword embeddings.  Hashed word and character n-gram vectors
are averaged per document and go through a softmax; both layers are learnt by numpy
stochastic gradient descent.

Features of a text are its words and the ``GRAMS``-character n-grams inside and at the edges
of words, case kept (it tells quality), and a mark for each word that also stands up to
``REPEATS`` words before, all hashed into ``buckets``.
Averaging and the output layer are linear, so scoring looks up one projected number for each
feature: the result is that of the averaged vectors.

Learning uses a sample of ``per_class`` labelled documents of each class at most (a documented
bound: the driver holds about 10 kB for each), weighted back to the classes' true shares.
Every document is scored over its whole text.

Defined cases: null and empty texts have no features and get the softmax of the biases; a
repeated label row counts once, contradicting ones by their majority, ties as 0; without
labels of both classes every score is the share of label 1 (0.5 without labels); repeated
documents are scored each on its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import held_out, sample_share, shared
from quillon.llm.words import U, codes, mix, pieces

BUCKETS = 1 << 16
GRAMS = (3, 4)
#: A word that stands again this many words later at most gives a feature of its own.
REPEATS = 4


def features(some: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the texts and the number of the text each belongs to, in text order by kind."""
    c, at = codes(some)
    blank = (c == 32) | ((c >= 9) & (c <= 13))
    c = np.where(blank, np.uint32(32), c).astype(U)
    found, owner = [], []
    for n in GRAMS:
        k = len(c) - n + 1
        if k > 0:
            good = ~blank[1 : 1 + k]
            h = c[:k].copy()
            for j in range(1, n):
                h *= U(0x100000001B3)
                h += c[j : j + k]
                if j < n - 1:
                    good = good & ~blank[j : j + k]
            where = np.flatnonzero(good)
            found.append(mix(h[where] + U(n)) & U(buckets - 1))
            owner.append(np.searchsorted(at, where, "right") - 1)
    start = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    end = np.flatnonzero(~blank & np.concatenate((blank[1:], [True]))) + 1
    if len(start):
        up = np.cumprod(np.full(len(c) + 1, 0x9E3779B97F4A7C15 | 1, U))
        total = np.concatenate((np.zeros(1, U), np.cumsum((c + U(1)) * up[:-1])))
        down = np.cumprod(np.full(len(c) + 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64), U))
        h = mix((total[end] - total[start]) * down[start])
        own = np.searchsorted(at, start, "right") - 1
        found.append(h & U(buckets - 1))
        owner.append(own)
        for k in range(1, REPEATS + 1):
            again = np.flatnonzero((h[k:] == h[:-k]) & (own[k:] == own[:-k])) + k
            found.append(np.full(len(again), mix(np.full(1, k, U))[0] & U(buckets - 1)))
            owner.append(own[again])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


@dataclass
class Model:
    """The table projected on the output layer's difference between label 1 and 0, and that of the biases."""

    table: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for rows, some in pieces(texts):
            f, own = features(some, len(self.table))
            np.add.at(total, rows, np.bincount(own, self.table[f], len(some)))
            np.add.at(count, rows, np.bincount(own, minlength=len(some)))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -500, 500)))


def learn(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, buckets: int = BUCKETS, dim: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent over documents given as (distinct features, counts)."""
    share = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.5
    if not 0 < share < 1:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(buckets), float(np.log(share / (1 - share))))
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    step, steps = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in random.permutation(len(docs)):
            f, n = docs[i]
            lr = np.float32(rate * (1 - step / steps) * weights[i])
            step += 1
            part = (n / n.sum()).astype(np.float32) if len(f) else n
            hidden = part @ vectors[f] if len(f) else np.zeros(dim, np.float32)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            err = p / p.sum()
            err[int(labels[i])] -= 1
            back = err @ out
            out -= lr * np.outer(err, hidden)
            bias -= lr * err
            if len(f):
                # The mean over many features moves each vector little; as usual each gets the whole gradient.
                vectors[f] -= lr * (part * len(f))[:, None] * back
    return Model((vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        sums: dict[int, list[np.ndarray]] = {}
        for rows, some in pieces(texts):
            f, own = features(some, buckets)
            order = np.argsort(own, kind="stable")
            f, cuts = f[order], np.searchsorted(own[order], np.arange(len(some) + 1))
            for k, row in enumerate(rows):
                sums.setdefault(row, []).append(np.stack(np.unique(f[cuts[k] : cuts[k + 1]], return_counts=True)))
        ids, counts = [], []
        for row in range(len(texts)):
            f, n = np.concatenate(sums.pop(row, [np.zeros((2, 0), np.int64)]), axis=1)
            f, at = np.unique(f, return_inverse=True)
            ids.append(f.astype(np.int32))
            counts.append(np.bincount(at, n, len(f)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("weight"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "label", "weight", "f", "n"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 3000, train: Column | None = None, buckets: int = BUCKETS) -> Model:
    """Learn from ``labels`` (0 or 1 by document); ``train`` tells which labels may be used."""
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where("doc_id is not null and label in (0, 1)")
    rows = rows.where(train) if train is not None else rows
    rows = rows.groupBy("doc_id").agg((F.avg("label") > 0.5).cast("int").alias("label"))
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    some = sample_share(rows, F.col("doc_id"), "label", per_class)
    weight = F.when(F.col("label") == 1, F.lit(float(max(1, n.get(1, 0) / per_class)))).otherwise(F.lit(float(max(1, n.get(0, 0) / per_class))))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    joined = texts.join(F.broadcast(some.withColumn("weight", weight)), "doc_id")  # 2 x per_class rows, by hash
    got = joined.select("doc_id", "label", "weight", "text").mapInArrow(lambda b: _counted(b, buckets), "doc_id long, label int, weight double, f array<int>, n array<int>").toArrow().sort_by("doc_id")
    pairs = [(np.asarray(f.values), np.asarray(c.values, np.float32)) for f, c in zip(got["f"], got["n"], strict=True)]
    w = got["weight"].to_numpy()
    return learn(pairs, got["label"].to_numpy(), w / w.mean() if len(w) else w, buckets)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", cut: float = 0.3) -> DataFrame:
    """doc_id, score (how likely label 1 is) and predicted (1 where it is ``cut`` or more)."""
    get = shared(docs.sparkSession, model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(judge, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
