"""Text functions: tokens, normalisation, content types, sentences, similarity, paths, chunks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The words that carry no topic.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")
SPACE = r"(?U)\s+"
#: From the first letter or digit between white space to the last.  The classes spell out ``(?U)\\s`` and
#: plain letters, which Java looks up faster; nothing in it recurses on long texts.
BLANK = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
CORE = rf"[a-z0-9\p{{L}}\p{{N}}]++(?:[^{BLANK}]*[a-z0-9\p{{L}}\p{{N}}])?"


def tokens(text: Column) -> Column:
    """Lower-cased, split at white space, other than letters and digits cut from both ends, empties dropped."""
    return F.regexp_extract_all(F.lower(text), F.lit(CORE), F.lit(0))


def word_set(text: Column, lower: bool = True) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text) if lower else text, SPACE), lambda t: t != ""))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Of two arrays of distinct entries."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def char_ngrams(text: Column, n: int) -> Column:
    """All n-character windows of the lower-cased text, in one pass; a shorter text is its own."""
    low = F.lower(text)
    windows = F.regexp_extract_all(low, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.when(F.length(low) <= n, F.array(low)).otherwise(windows)


def term_frequency(text: Column, terms: Column) -> Column:
    """The share of the terms that the text contains."""
    low = F.lower(text)
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t)))) / F.nullif(F.size(terms), F.lit(0)))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda t: t != "")


#: What a telling sentence contains.
TELLING = ("is", "provides", "supports", "enables", "allows")


def sentence_quality(sentence: Column) -> Column:
    """0.5, more for 8 to 30 words, a capital first, an ending mark and a telling word; 1 at most."""
    n = F.size(words(sentence))
    add = lambda c, v: F.when(c, v).otherwise(0.0)
    telling = F.lower(sentence).rlike("|".join(TELLING))
    total = 0.5 + add(n.between(8, 30), 0.2) + add(sentence.rlike(r"^\p{Lu}"), 0.1) + add(sentence.rlike(r"[.!?]$"), 0.1) + add(telling, 0.1)
    return F.least(F.lit(1.0), total)


def sentences(text: Column, least: int = 0) -> Column:
    """Split at . ! ? and line ends; pieces of ``least`` characters or fewer drop out."""
    return F.filter(F.transform(F.split(text, r"[.!?\n]"), lambda s: F.trim(s)), lambda s: F.length(s) > least)


def marked_sentences(text: Column, least: int = 10) -> Column:
    """Sentences with their ending mark."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]?"), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, SPACE, " "))), lambda s: F.length(s) > least)


def unicode_form(text: Column, form: str) -> Column:
    """NFC or NFKC, which Spark has no function for."""

    @F.pandas_udf(StringType())
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return apply(text)


def normalized(text: Column, level: str = "moderate", unicode: bool = True) -> Column:
    """``conservative``: line ends, BOM, blanks at line ends.  ``moderate``: also zero-width
    characters and at most one empty line.  ``aggressive``: also control characters and runs of blanks."""
    if unicode:
        text = unicode_form(text, "NFKC" if level == "aggressive" else "NFC")
    text = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+(?=\n)|[ \t]+$", "")
    if level != "conservative":
        text = F.regexp_replace(text, "[​‌‍⁠﻿]", "")
        text = F.regexp_replace(text, "\n{3,}", "\n\n")
    if level == "aggressive":
        text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
        text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.regexp_replace(text, r"^\s+|\s+$", "") if level != "conservative" else text


def payload_text(text: Column) -> Column:
    """How stored payload text is returned: LF only, two line ends in a row at most, lines and text trimmed."""
    text = F.regexp_replace(text, "\r\n", "\n")
    text = F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"[ \t]+(?=\n)", "")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


EXTENSIONS = {"html": "html", "htm": "html", "json": "json", "md": "markdown", "markdown": "markdown", "csv": "table", "tsv": "table", "py": "code", "rs": "code", "js": "code", "ts": "code", "go": "code", "java": "code", "c": "code", "cpp": "code"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def content_type(text: Column, path: Column | None = None) -> Column:
    """By extension, else html, json, markdown (over two marked lines), code, table, plain on the first 50 lines."""
    head = F.substring_index(text, "\n", 50)
    count = lambda p: F.regexp_count(head, F.lit(p))
    guess = (
        F.when(head.rlike(r"(?i)<!doctype html|<html|<(div|p|body|head)[ >]"), "html")
        .when(head.rlike(r"^\s*[\{\[]") & F.trim(text).rlike(r"[\}\]]\s*$"), "json")
        .when(count(r"(?m)^(#{1,6} |[-*] |\d+\. |```|> )") > 2, "markdown")
        .when(count(r"(?m)(\bfn |\bdef |\bclass |\bimport |\bfunction |\breturn |;\s*$|[{}]\s*$)") > 2, "code")
        .when(count(r"(?m)^[^\n]*\|[^\n]*\|") > 2, "table")
        .otherwise("plain")
    )
    if path is None:
        return guess
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, extension(path)), guess)


def chunk(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """Byte offset and text of chunks of at most ``size`` bytes, cut after the last blank or
    sentence mark in the window, each starting ``overlap`` bytes before the last one's end."""
    raw, out, start = text.encode(), [], 0
    while start < len(raw):
        end = min(len(raw), start + size)
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        if end < len(raw):
            cut = max(m.end() for m in [re.match(b"", b""), *re.finditer(rb"[\s.!?]", raw[start:end])])
            end = start + cut if cut else end
        piece = raw[start:end].decode()
        if piece.strip():
            out.append((start, piece.strip()))
        if end >= len(raw):
            break
        start = max(end - overlap, start + 1)
        while start < end and raw[start] & 0xC0 == 0x80:
            start += 1
    return out


def chunks(df: DataFrame, path: str, text: str, size: int = 2048, overlap: int = 256) -> DataFrame:
    """Chunks of files: chunk_id (path#number), path, chunk_index, start (byte) and content."""
    schema = "path string, chunk_id string, chunk_index int, start long, content string"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for p, t in zip(batch.column(0), batch.column(1), strict=True):
                p = p.as_py()
                for i, (a, c) in enumerate(chunk(t.as_py() or "", size, overlap)):
                    rows.append((p, f"{p}#{i}", i, a, c))
                    held += len(c)
                    if held > HELD:
                        yield chunk_batch(rows)
                        rows, held = [], 0
        if rows:
            yield chunk_batch(rows)

    return df.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(split, schema)


HELD = 1 << 21  # characters of chunks that a worker holds at a time


def chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "chunk_id", "chunk_index", "start", "content"])
