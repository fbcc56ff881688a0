"""Payload filters: a tree of conditions over a JSON column, compiled to one two-valued Column.

A filter is ``{"must": [...], "must_not": [...], "should": [...]}``; a condition is another
filter or a leaf with ``key`` (dotted path) and one of ``match``, ``range``, ``geo_box``,
``geo_radius``, ``values_count``.  A key that is missing makes a leaf false, never null, so
``must_not`` on it passes.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


class Payload:
    """A JSON string column, parsed once."""

    def __init__(self, json: Column):
        self.variant = F.try_parse_json(json)

    def at(self, key: str) -> Column:
        return F.try_variant_get(self.variant, "$." + key, "variant")

    def type(self, key: str) -> Column:
        return F.schema_of_variant(self.at(key))

    def text(self, key: str) -> Column:
        return F.when(self.type(key) == "STRING", F.try_variant_get(self.variant, "$." + key, "string"))

    def integer(self, key: str) -> Column:
        return F.when(self.type(key) == "BIGINT", F.try_variant_get(self.variant, "$." + key, "bigint"))

    def number(self, key: str) -> Column:
        kind = self.type(key)
        return F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(self.variant, "$." + key, "double"))

    def truth(self, key: str) -> Column:
        return F.when(self.type(key) == "BOOLEAN", F.try_variant_get(self.variant, "$." + key, "boolean"))

    def point(self, key: str) -> tuple[Column, Column]:
        """Latitude and longitude of {lat, lon} or [lat, lon]."""
        return F.coalesce(self.number(key + ".lat"), self.number(key + "[0]")), F.coalesce(self.number(key + ".lon"), self.number(key + "[1]"))


def haversine(lat: Column, lon: Column, of_lat: float, of_lon: float, radius: float = EARTH_M) -> Column:
    p, q = F.radians(lat), F.radians(F.lit(float(of_lat)))
    half = F.pow(F.sin((q - p) / 2), F.lit(2.0)) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(F.lit(float(of_lon)) - lon) / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def _range(value: Column, bounds: dict) -> Column:
    out = value.isNotNull()
    for name, of in bounds.items():
        limit = F.lit(float(of))
        out &= {"gt": value > limit, "gte": value >= limit, "lt": value < limit, "lte": value <= limit}[name]
    return out


def _match(p: Payload, key: str, match: dict) -> Column:
    if match.get("any"):
        return p.at(key).isNotNull() & ~F.is_variant_null(p.at(key))
    if "text" in match:
        how, text = match.get("how", "contains"), p.text(key)
        return {"exact": text == match["text"], "prefix": text.startswith(match["text"]), "suffix": text.endswith(match["text"]), "contains": text.contains(match["text"])}[how]
    value = match["value"]
    if isinstance(value, bool):
        return p.truth(key) == value
    return p.integer(key) == value if isinstance(value, int) else p.text(key) == value


def _leaf(p: Payload, c: dict) -> Column:
    key = c["key"]
    if "match" in c:
        return _match(p, key, c["match"])
    if "range" in c:
        return _range(p.number(key), c["range"])
    if "geo_box" in c:
        (lat, lon), box = p.point(key), c["geo_box"]
        return lat.between(box["min_lat"], box["max_lat"]) & lon.between(box["min_lon"], box["max_lon"])
    if "geo_radius" in c:
        (lat, lon), g = p.point(key), c["geo_radius"]
        return haversine(lat, lon, g["lat"], g["lon"]) <= g["radius"]
    if "values_count" in c:
        text, kind = F.to_json(p.at(key)), p.type(key)
        n = F.when(kind.startswith("ARRAY"), F.json_array_length(text)).when(kind.startswith("OBJECT"), F.size(F.json_object_keys(text))).when(kind == "STRING", F.octet_length(p.text(key)))
        return _range(n.cast("double"), c["values_count"])
    raise ValueError(f"unknown condition {c}")


def compiled(json: Column, tree: dict) -> Column:
    """The filter as a Column that is true or false for every row."""
    payload = Payload(json)

    def of(node: dict) -> Column:
        if "key" in node:
            return F.coalesce(_leaf(payload, node), F.lit(False))
        out = F.lit(True)
        for c in node.get("must", []):
            out &= of(c)
        for c in node.get("must_not", []):
            out &= ~of(c)
        if node.get("should"):
            some = F.lit(False)
            for c in node["should"]:
                some |= of(c)
            out &= some
        return out

    return of(tree)


def has_terms(text: Column, query: str) -> Column:
    """Text index lookup: every lower-cased alphanumeric token of the query is a token of the text."""
    tokens = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    wanted = [t for t in "".join(c if c.isalnum() else " " for c in query.lower()).split()]
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tokens)) == 0 if wanted else F.lit(False)


def glob(name: Column, include: list[str], exclude: list[str]) -> Column:
    """A name that an include pattern matches (all, if there are none) and no exclude pattern does."""
    match = lambda p: name.rlike(fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$"))
    some = F.lit(not include)
    for p in include:
        some |= match(p)
    for p in exclude:
        some &= ~match(p)
    return some
