"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Four base patterns (email, ip, card, phone) give the seed spans.  Seeds induce lexical
patterns: the word before and the word after an identifier, together, with its kind.  Spark
then scores the graph of patterns and instances in rounds: a pattern is as good as the share
of its instances (seed or candidate) that are believed, an instance as believed as its best
patterns say; seeds are always believed.  Patterns with ``support`` distinct seeds or more and
a score of ``confident`` or more accept unseen candidates (tokens with ``digits`` digits or
more, or an at sign, outside every base span) as spans of their kind.

Positions are code points.  A pattern's matches come from ``split`` and ``regexp_extract_all``
with the same expression, so the lengths of the pieces between them give their places; prefix
sums are taken in blocks, so a text with a great many spans stays cheap.  The expressions are
written so that a match is tried only where a run of its characters starts or the last match
ended, with possessive loops: the time is linear in the text and no match recurses.

Defined cases: null and empty texts have no spans; a part over 255, a wrong number of digits
or a failed Luhn sum drops the match and what it covers is not tried again; spans of different
kinds may overlap; repeated documents are judged each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.store import cut

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
EXPRESSIONS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for its matches to be looked for at all.
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_TOKEN = r"(?<![^ \t\n\x0B\f\r])[^ \t\n\x0B\f\r0-9@]*+[0-9@][^ \t\n\x0B\f\r]*+"
_BLOCK = 256
_FOUND = "array<struct<kind:int,start:long,end:long,before:string,after:string,surface:string>>"


def _good(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "card":
        each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.when(d.cast("int") >= 5, 1).otherwise(0)))
        luhn = F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0
        return F.when(F.length(digits).between(14, 19), luhn).otherwise(F.lit(False))
    return F.lit(True)


def _passes(kind: str):
    return lambda s: _good(kind, s["surface"])


def _starts(lengths: Column) -> Column:
    """Running sums before each entry of an array, in blocks."""
    add = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / _BLOCK).cast("int")), lambda b: add(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))))
    before = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))
    return before, add


def _matches(text: Column, expression: str, kind: int, needs: Column, good: Column | None = None) -> Column:
    """All matches as structs with their places and the words around them."""
    pieces = F.split(text, expression, -1)
    found = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    both = F.struct(pieces.alias("p"), found.alias("m"))
    none = F.array().cast(_FOUND)

    def placed(x: Column) -> Column:
        p, m = x["p"], x["m"]
        lengths = F.zip_with(F.slice(p, F.lit(1), F.size(m)), m, lambda a, b: F.struct(F.length(a).cast("long").alias("gap"), F.length(b).cast("long").alias("own")))
        steps = F.transform(lengths, lambda v: v["gap"] + v["own"])
        before, add = _starts(steps)
        with_sums = F.struct(p.alias("p"), m.alias("m"), steps.alias("s"), before.alias("b"))

        def one(y: Column) -> Column:
            def span(surface: Column, i: Column) -> Column:
                block = F.floor(i / _BLOCK).cast("int")
                end = F.element_at(y["b"], block + 1) + add(F.slice(y["s"], block * _BLOCK + 1, i - block * _BLOCK + 1))
                left = F.lower(F.regexp_extract(F.right(F.element_at(y["p"], i + 1), F.lit(40)), r"([^ \t\n\x0B\f\r]+)[ \t\n\x0B\f\r]*$", 1))
                right = F.lower(F.regexp_extract(F.left(F.element_at(y["p"], i + 2), F.lit(40)), r"^[^A-Za-z\x80-￿]*([^ \t\n\x0B\f\r]+)", 1))
                return F.struct(F.lit(kind).alias("kind"), (end - F.length(surface)).alias("start"), end.alias("end"), left.alias("before"), right.alias("after"), surface.alias("surface"))

            return F.transform(y["m"], span)

        return F.element_at(F.transform(F.array(with_sums), one), 1)

    spans = F.element_at(F.transform(F.array(both), placed), 1)
    return F.when(needs, spans).otherwise(none)


def base_spans(text: Column) -> Column:
    """Seed spans of all kinds, by start, then kind as listed."""
    parts = []
    for k, kind in enumerate(KINDS):
        needs = text.rlike("[0-9]") if kind in ("ip", "card", "phone") else F.lit(True)
        needs = needs & text.contains(_NEEDS[kind]) if _NEEDS[kind] else needs
        needs = needs & (text.rlike(EXPRESSIONS[kind]))
        parts.append(F.filter(_matches(text, EXPRESSIONS[kind], k, needs), _passes(kind)))
    return F.array_sort(F.concat(*parts), lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"]))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scored_patterns(seeds: DataFrame, candidates: DataFrame, rounds: int = 3) -> DataFrame:
    """before, after, kind, seeds (distinct) and score of each pattern.

    ``seeds`` (kind, before, after, surface) and ``candidates`` (before, after, surface) are
    instances; sums are taken by pattern and by instance, with partial sums before each shuffle.
    """
    pattern = ["before", "after"]
    s = seeds.where("before <> '' and after <> ''").groupBy(*pattern, "kind", "surface").agg(F.count("*").alias("n")).withColumn("seed", F.lit(True))
    induced = s.groupBy(*pattern, "kind").agg(F.count("*").alias("seeds"))
    c = candidates.where("before <> '' and after <> ''").groupBy(*pattern, "surface").agg(F.count("*").alias("n"))
    c = c.join(induced.select(*pattern, "kind"), pattern).withColumn("seed", F.lit(False))
    edges = cut(s.unionByName(c), "pii-edges")
    believed = edges.select("kind", "surface", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("belief")).groupBy("kind", "surface").agg(F.max("belief").alias("belief"))
    scores = None
    for _ in range(rounds):
        scores = edges.join(believed, ["kind", "surface"]).groupBy(*pattern, "kind").agg((F.sum("belief") / F.count("*")).alias("score"))
        doubt = edges.join(scores, [*pattern, "kind"]).groupBy("kind", "surface").agg(F.max("seed").alias("seed"), F.max("score").alias("best"))
        believed = doubt.select("kind", "surface", F.when(F.col("seed"), 1.0).otherwise(F.col("best")).alias("belief"))
    return scores.join(induced, [*pattern, "kind"])


def _every(docs: DataFrame, keep: list, text: str, support: int = 3, confident: float = 0.8, digits: int = 5, rounds: int = 3) -> DataFrame:
    """The columns ``keep`` of each row with its own ``__base`` and ``__spans``.  A row is known by a
    number given before the first cut, never by its id, which may be null or stand in several rows."""
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__body"))
    body = F.col("__body")
    tokens = F.filter(_matches(body, _TOKEN, -1, body.rlike(r"[0-9@]")), lambda t: t["surface"].contains("@") | (F.length(F.regexp_replace(t["surface"], "[^0-9]", "")) >= digits))
    found = cut(rows.select("*", F.monotonically_increasing_id().alias("__row"), base_spans(body).alias("__base"), tokens.alias("__tokens")).drop("__body"), "pii-spans")
    place = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    seeds = found.select(F.explode("__base").alias("s")).select("s.*")
    apart = F.filter("__tokens", lambda t: ~F.exists("__base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    candidates = cut(found.where(F.size("__tokens") > 0).select("__row", F.explode(apart).alias("t")).select("__row", "t.*").drop("kind"), "pii-candidates")
    strong = scored_patterns(seeds, candidates, rounds).where((F.col("seeds") >= support) & (F.col("score") >= confident))
    best = strong.groupBy("before", "after").agg(F.max(F.struct("score", -F.col("kind"))).alias("b")).select("before", "after", (-F.col("b.col2")).alias("kind"))
    added = candidates.join(best, ["before", "after"]).groupBy("__row").agg(F.array_distinct(F.collect_list(F.struct("kind", "start", "end"))).alias("__more"))
    out = found.drop("__tokens").withColumn("__base", F.transform("__base", place)).join(added, "__row", "left")
    every = F.array_sort(F.concat("__base", F.coalesce("__more", F.array().cast("array<struct<kind:int,start:long,end:long>>"))), lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"]))
    return out.withColumn("__spans", every).drop("__row", "__more")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = 3, confident: float = 0.8, digits: int = 5, rounds: int = 3) -> DataFrame:
    """Per document: ``base`` and ``spans`` (base and discovered), arrays of kind, start, end."""
    return _every(docs, [F.col(doc_id).cast("long").alias("doc_id")], text, support, confident, digits, rounds).select("doc_id", F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span, base or discovered, replaced by its kind in brackets; where
    spans overlap, the earliest stands for all.  Rows without spans keep their text as it is."""
    joined = _every(docs, ["*"], text).drop("__base")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    merged = F.aggregate("__spans", F.array().cast("array<struct<kind:int,start:long,end:long>>"), lambda a, s: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] > s["start"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.try_element_at(a, F.lit(-1))["kind"].alias("kind"), F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(s))))
    joined = joined.withColumn("__spans", merged)
    body = F.col(text)
    pieces = F.transform("__spans", lambda s, i: F.concat(F.substring(body, (F.when(i == 0, F.lit(0)).otherwise(F.try_element_at("__spans", i)["end"]) + 1).cast("int"), (s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.try_element_at("__spans", i)["end"])).cast("int")), F.element_at(names, s["kind"] + 1)))
    rest = F.substring(body, (F.element_at("__spans", -1)["end"] + 1).cast("int"), F.length(body))
    return joined.withColumn(text, F.when(F.size("__spans") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(body)).drop("__spans")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their digest, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
