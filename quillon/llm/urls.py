"""URL filters: rules by host and path, and a character language-model ratio for the rest.

Two smoothed Markov models of variable order, one of accepted and one of rejected URLs, give
every URL the difference of its log-likelihoods per character.  Counts of a character after
its last 0 to ``order`` characters come from all labelled URLs, by DataFrame sums; orders are
interpolated by Witten-Bell: a context that has seen many different characters trusts the
next shorter one more.  The threshold is calibrated on a fifth of the labelled URLs that the
models do not see, as the value that parts them best (mean of both classes' hit rates).

Counts are kept in full, as tables that grow with what the URLs hold: a string of up to ``order``
bytes and the byte after it is a number, exactly.  Order by order the strings that occur in any
URL are joined to their counts and to the probability at one order less; contexts have at most 256
bytes after them, so no key is hot there.  A URL's bytes then meet the values of their
strings, which are salted, as some strings stand in nearly every URL.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is
scored like any other (null as the empty string, ratio 0, allowed); with URLs of one class
only everything is allowed; ties with the threshold are allowed; repeated rows are judged each on
its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.store import cut
from quillon.llm.common import held_out
from quillon.llm.words import RUN, buffers

ORDER = 4
#: Parts that the bytes of one string are dealt into.
SALTS = 16
#: The rules, as host and path, and what they say.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits: its host, or a host under it, and the start of the path."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        own, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def grams(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """From (key, url): key, how many bytes stand before a byte (``order`` at most), these and the
    byte as one number, and how often, summed within a run of bytes."""
    for batch in batches:
        data, at = buffers(batch.column(1))
        keys = batch.column(0).to_numpy()
        for a in range(0, len(data), RUN):
            p = np.arange(a, min(len(data), a + RUN))
            row = np.searchsorted(at, p, "right") - 1
            have = np.minimum(p - at[row], order)
            gram = np.zeros(len(p), np.int64)
            for back in range(order, -1, -1):
                gram = gram << 8 | np.where(have >= back, data[np.maximum(p - back, 0)], 0)
            key = keys[row]
            by = np.lexsort((gram, have, key))
            key, have, gram = key[by], have[by], gram[by]
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (have[1:] != have[:-1]) | (gram[1:] != gram[:-1]))))
            n = np.diff(np.concatenate((new, [len(key)])))
            columns = key[new], have[new].astype(np.int32), gram[new], n.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "have", "gram", "n"])


def grams_of(urls: DataFrame, key: str, order: int) -> DataFrame:
    return urls.select(F.col(key).cast("long"), "url").mapInArrow(lambda x: grams(x, order), "key long, have int, gram long, n long")


def fit(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """How often each string of ``labelled`` (url, accept: 0 or 1) occurs: have, gram, n0 (rejected), n1 (accepted)."""
    if not 0 <= order <= 6:
        raise ValueError("order must be from 0 to 6: a string and its next byte are kept in 56 bits")
    n = [F.sum(F.when(F.col("key") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)]
    return cut(grams_of(labelled, "accept", order).groupBy("have", "gram").agg(*n), "url-grams")


def values(counts: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """have, gram and value (log accepted - log rejected) of the strings ``wanted`` (have, gram)."""
    p0 = p1 = F.lit(1 / 256)
    level, out = None, None
    for o in range(order + 1):
        last = F.col("gram").bitwiseAND(F.lit((1 << 8 * (o + 1)) - 1)).alias("last")
        context = F.shiftright("last", 8).alias("context")
        seen = counts.where(F.col("have") >= o).groupBy(last).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        after = seen.groupBy(context).agg(F.sum("n0").alias("all0"), F.sum("n1").alias("all1"), F.count_if(F.col("n0") > 0).alias("kinds0"), F.count_if(F.col("n1") > 0).alias("kinds1"))
        here = wanted.where(F.col("have") >= o).select(last).distinct().select("last", context)
        here = here.join(seen, "last", "left").join(after, "context", "left")
        if level is not None:
            shorter = level.select(F.col("last").alias("shorter"), "p0", "p1")
            here = here.withColumn("shorter", F.col("last").bitwiseAND(F.lit((1 << 8 * o) - 1))).join(shorter, "shorter")
            p0, p1 = F.col("p0"), F.col("p1")
        mixed = []
        for k, p in enumerate((p0, p1)):
            own = (F.coalesce(f"n{k}", F.lit(0)) + F.col(f"kinds{k}") * p) / (F.col(f"all{k}") + F.col(f"kinds{k}"))
            mixed.append(F.when(F.col(f"all{k}") > 0, own).otherwise(p).alias(f"p{k}"))
        level = cut(here.select("last", *mixed), f"url-order-{o}")
        done = level.select(F.lit(o).alias("have"), F.col("last").alias("gram"), (F.log("p1") - F.log("p0")).alias("value"))
        out = done if out is None else out.unionByName(done)
    return out


def scored(urls: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``urls`` (row: a number of its own, url) with ``ratio``: the mean value over a URL's bytes; 0 of an empty one."""
    cells = grams_of(urls, "row", order)
    wanted = cut(cells.select("have", "gram").distinct(), "url-wanted")
    salted = values(counts, wanted, order).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cells = cells.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    means = cells.join(salted, ["have", "gram", "salt"]).groupBy(F.col("key").alias("row")).agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"))
    return urls.join(means, "row", "left").withColumn("ratio", F.round(F.coalesce("mean", F.lit(0.0)), 9)).drop("mean")


def threshold(judged: DataFrame, steps: int = 1000) -> float:
    """The ratio that parts ``judged`` (ratio, accept) best, from counts in bins of 1 / ``steps``."""
    bins = judged.groupBy(F.round(F.greatest(F.lit(-16.0), F.least(F.lit(16.0), "ratio")) * steps).cast("int").alias("bin"), "accept").agg(F.count("*").alias("n")).toPandas()
    if bins["accept"].nunique() < 2:
        return float("-inf")
    table = bins.pivot_table(index="bin", columns="accept", values="n", fill_value=0).sort_index()
    rejected, accepted = table[0].cumsum() / table[0].sum(), 1 - table[1].cumsum() / table[1].sum()
    gain = (rejected + accepted).to_numpy()
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    edge = table.index.to_numpy()
    low = edge[best[0]]
    high = edge[min(best[-1] + 1, len(edge) - 1)]
    return float((low + high) / 2 / steps)


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict and ratio; URLs that a rule decides are what is learnt from."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    said = F.lit(None).cast("string")
    for rule, verdict in rules:
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("said", said)
    rows = rows.withColumn("accept", F.when(F.col("said").isNotNull(), (F.col("said") == "allow").cast("int")))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "urls")
    labelled = rows.where("accept is not null")
    counts = fit(labelled.where(~held_out("page_id")), order)
    ratios = scored(rows.select("row", "url"), counts, order).select("row", "ratio")
    judged = cut(rows.drop("url").join(ratios, "row"), "urls-judged")
    least = threshold(judged.where(F.col("accept").isNotNull() & held_out("page_id")).select("ratio", "accept"))
    likely = (F.col("ratio") >= least) | (F.length("host") == 0) & (F.col("ratio") == 0)
    verdict = F.coalesce("said", F.when(likely, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "ratio")
