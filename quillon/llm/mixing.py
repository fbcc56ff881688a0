"""Mixing sources to target weights over a time-varying curriculum, with DataFrame functions only.

Sizes are words.  Sources in code-point order, null last, get the weights 1, 2, 3, repeating;
targets share the whole size by weight and stop at ``max_repeats`` times the source's size,
the excess going to the others by weight (water filling, in closed form over the sources).

Each source's weight varies over training time u in [0, 1] as 1 - slope + 2 * slope * u, which
integrates to F(u) = (1 - slope) * u + slope * u * u.  The slope goes from -``tilt`` to ``tilt``
with the source's number, so early sources lead and late ones follow.  A source's words are
taken pass after pass in the order of the id's md5; the words before a document, as a
share of the target, are cumulative demand, and F inverted gives its training position.
Documents are range-sorted by position.

The last document of the last pass is taken in part, so a source's taken words are its target
rounded.  Running sums go over the 16**``digits`` buckets of a source by its ids' md5, so a
source with a third of all rows is many groups; sources meet in a table of one row each.

Defined cases: null and empty texts have size 0, are taken 0 times and get the position their
turn has; a source of size 0 has target 0; repeated documents are rows of their own, ordered
by their text's hash, and equal rows share a turn's words as one row after another; an empty
table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.store import cut

_GAP = r"[ \t\n\x0B\f\r]"
_WORD = r"[^ \t\n\x0B\f\r]"


def words_in(text: str | Column) -> Column:
    """The number of words; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    one_each = F.length(F.regexp_replace(text, f"{_GAP}*+{_WORD}++{_GAP}*+", "x"))
    return F.when(text.rlike(_WORD), one_each).otherwise(0).cast("long")


def targets(sizes: DataFrame, max_repeats: float = 3.0, tilt: float = 0.8) -> DataFrame:
    """source_size by ``source`` in; adds target and slope.  One row for each source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    all_rows = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double")).withColumn("cap", max_repeats * F.col("source_size"))
    # Those whose cap is least for their weight fill first: with the first k full, the others share what is left.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    share = F.max(F.when(~F.col("full"), F.col("level"))).over(all_rows)
    n = F.count("*").over(all_rows)
    slope = F.when(n > 1, tilt * (2 * (F.col("rank") - 1) / (n - 1) - 1)).otherwise(0.0)
    return leveled.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * share))).withColumn("slope", slope).select("source", "source_size", "target", "slope")


def when_reached(share: Column, slope: Column) -> Column:
    """The time at which a source has had this share of its words: F inverted."""
    share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return 2 * share / ((1 - slope) + root)


def mix(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", max_repeats: float = 3.0, tilt: float = 0.8, digits: int = 3) -> DataFrame:
    """Per document: size, source_size, target, taken (words, repeats counted) and the training
    positions of its copies, earliest first; range-sorted by the first."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(text).alias("size"), F.xxhash64(text).alias("__text"))
    rows = rows.withColumn("__turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    rows = cut(rows.withColumn("__bucket", F.substring("__turn", 1, digits)), "sizes")
    by_bucket = rows.groupBy("source", "__bucket").agg(F.sum("size").alias("__size"))
    order = Window.partitionBy("source").orderBy("__bucket")
    starts = by_bucket.withColumn("__before", F.coalesce(F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    planned = targets(by_bucket.groupBy("source").agg(F.sum("__size").alias("source_size")), max_repeats, tilt)
    same = starts["source"].eqNullSafe(planned["source"])
    plan = starts.join(planned, same).select(starts["source"].alias("__source"), F.col("__bucket").alias("__b"), "__before", "source_size", "target", "slope")
    within = Window.partitionBy("source", "__bucket").orderBy("__turn", "doc_id", "__text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__b")))
    start = F.col("__before") + F.col("__within")
    whole = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), whole - full * F.col("source_size") - start))
    rows = rows.withColumn("taken", full * F.col("size") + rest).withColumn("__start", start).withColumn("__copies", full + F.when(rest > 0, 1).otherwise(0))
    at = lambda k: when_reached((k * F.col("source_size") + F.col("__start")) / F.greatest(F.col("target"), F.lit(1.0)), F.col("slope"))
    positions = F.transform(F.when(F.col("__copies") > 0, F.sequence(F.lit(0), F.col("__copies") - 1)).otherwise(F.array().cast("array<long>")), at)
    return rows.select("doc_id", "size", "source_size", "target", "taken", positions.alias("positions"), at(F.lit(0)).alias("position")).orderBy("position", "doc_id")


def schedule(mixed: DataFrame) -> DataFrame:
    """One row for each copy in training order: doc_id, position and words taken."""
    copies = mixed.select("doc_id", "size", "taken", F.posexplode("positions").alias("copy", "position"))
    return copies.select("doc_id", "copy", "position", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")).alias("words")).orderBy("position", "doc_id", "copy")
