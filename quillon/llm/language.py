"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  An n-gram's vector
binds (multiplies) its letters' vectors, each permuted (rotated) by its place; a document's
bundles (sums) the vectors of its n-grams, and a language's prototype those of its documents.
A document is compared with every prototype by cosine.

N-grams are taken inside words and at their edges after lower-casing; what is not a letter is
an edge.  Prototypes are learnt from about ``per_lang`` documents a language (a documented
bound, chosen by a hash of the id), summed in Spark; the driver holds one vector a language.

Defined cases: a null text, or one without letters, is ``und`` with score 0, as is every text
if nothing was learnt; ties go to the language first by code point; cosines under 0 score 0;
null languages teach nothing; repeated rows are judged each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import held_out, sample_share
from quillon.llm.words import U, codes, mix, pieces

DIM = 1024
GRAM = 3


_LETTERS: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def letter_vectors(letters: np.ndarray, dim: int) -> np.ndarray:
    """Rows of +1 and -1, the same for a code point everywhere."""
    seed = mix(letters.astype(U) + U(1))[:, None] + np.arange(dim // 64, dtype=U)[None, :]
    bits = np.unpackbits(mix(seed).view(np.uint8).reshape(len(letters), -1), axis=1)
    return (bits[:, :dim].astype(np.int8) * 2 - 1).astype(np.int8)


def bundles(texts: list[str | None], dim: int = DIM, run: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of each text, and whether it has letters."""
    out, lettered = np.zeros((len(texts), dim), np.float32), np.zeros(len(texts), bool)
    known = is_letter()
    for rows, some in pieces([(t or "").lower() for t in texts], run):
        c, at = codes(some)
        c = np.where(known[np.minimum(c, 0x10FFFF)], c, np.uint32(32))
        c = np.concatenate((np.full(1, 32, np.uint32), c))
        at = at + 1
        letters, c = np.unique(c, return_inverse=True)
        edge = int(np.searchsorted(letters, 32))
        width = len(letters)
        n = len(c) - GRAM + 1
        good = np.ones(n, bool)
        for j in range(1, GRAM - 1):
            good &= c[j : j + n] != edge
        where = np.flatnonzero(good)
        if not len(where):
            continue
        grams = c[where].astype(np.int64)
        for j in range(1, GRAM):
            grams = grams * width + c[where + j]
        if width**GRAM <= 1 << 22:
            seen = np.flatnonzero(np.bincount(grams, minlength=width**GRAM))
            place = np.zeros(width**GRAM, np.int32)
            place[seen] = np.arange(len(seen))
            grams = place[grams]
        else:
            seen, grams = np.unique(grams, return_inverse=True)
        own = np.searchsorted(at, where + 1, "right") - 1  # by the middle letter
        base = letter_vectors(letters, dim)
        step = max(64, (1 << 24) // dim)
        texts_at = np.searchsorted(own, np.arange(len(some) + 1))
        block = max(1, (1 << 22) // max(1, min(len(seen), step)))
        for a in range(0, len(seen), step):  # n-gram vectors, a bounded number at a time
            part = seen[a : a + step]
            vector = np.ones((len(part), dim), np.int8)
            rest = part.copy()
            for j in reversed(range(GRAM)):
                vector *= np.roll(base, GRAM - 1 - j, axis=1)[rest % width]
                rest //= width
            vector = vector.astype(np.float32)
            for b in range(0, len(some), block):
                e = min(len(some), b + block)
                g, o = grams[texts_at[b] : texts_at[e]], own[texts_at[b] : texts_at[e]] - b
                inside = (g >= a) & (g < a + len(part))
                count = np.bincount(o[inside] * len(part) + g[inside] - a, minlength=(e - b) * len(part)).reshape(e - b, len(part)).astype(np.float32)
                np.add.at(out, rows[b:e], count @ vector)
        lettered[np.asarray(rows)[np.unique(own)]] = True
    return out, lettered


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", train: Column | None = None, per_lang: int = 4000, dim: int = DIM) -> dict[str, np.ndarray]:
    """A prototype for each language of the documents that ``train`` lets through."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null")
    rows = rows.where(train) if train is not None else rows
    some = sample_share(rows, F.col("id"), "lang", per_lang)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            vectors, _ = bundles(batch.column("text").to_pylist(), dim)
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = vectors / np.where(norm > 0, norm, 1)
            langs = np.array(batch.column("lang").to_pylist(), object)
            for one in set(langs):
                total[one] = total.get(one, 0) + vectors[langs == one].sum(0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(total), dim).tolist(), pa.string()), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(total))), pa.array(np.round(np.concatenate(list(total.values())) * (1 << 20)).astype(np.int64))], names=["lang", "at", "v"])

    got = some.select("lang", "text").mapInArrow(sums, "lang string, at int, v long").groupBy("lang", "at").agg(F.sum("v").alias("v")).toPandas()  # dim rows a language
    out = {}
    for one, own in sorted(got.groupby("lang")):
        vector = np.zeros(dim)
        vector[own["at"].to_numpy()] = own["v"].to_numpy()
        if np.linalg.norm(vector):
            out[one] = vector / np.linalg.norm(vector)
    return out


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", keep: tuple[str, ...] = (), as_lang: str = "lang_pred", as_score: str = "score", dim: int = DIM) -> DataFrame:
    """The columns ``keep`` and the language and cosine of each text."""
    names = sorted(profiles)
    held = docs.sparkSession.sparkContext.broadcast(np.stack([profiles[n] for n in names]).astype(np.float32) if names else np.zeros((0, dim), np.float32))
    rows = docs.select(F.col(text).alias("__text"), *keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), f"`{as_lang}` string", f"`{as_score}` double"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            texts = batch.column(0).to_pylist()
            for a in range(0, len(texts), 1024):
                vectors, lettered = bundles(texts[a : a + 1024], dim)
                norm = np.linalg.norm(vectors, axis=1)
                cos = vectors @ held.value.T / np.where(norm > 0, norm, 1)[:, None]
                best = cos.argmax(1) if names else np.zeros(len(cos), int)
                for i, ok in enumerate(lettered):
                    langs.append(names[best[i]] if ok and names else "und")
                    scores.append(float(min(1, max(0, cos[i, best[i]]))) if ok and names else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], as_lang, as_score])

    return rows.mapInArrow(judge, schema)


def training(doc_id: str = "doc_id") -> Column:
    return ~held_out(F.col(doc_id).cast("long"))
