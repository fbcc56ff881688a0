"""Quantisation: per-vector and global scalar and binary codes, product codes, and their errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.vectors import doubles


def sq8(v: Column) -> Column:
    """Codes 0 to 255 by the vector's own range, truncated; a constant vector is all 0."""
    v = doubles(v)
    low, width = F.array_min(v), F.array_max(v) - F.array_min(v)
    return F.struct(F.transform(v, lambda x: F.when(width == 0, 0).otherwise(F.floor((x - low) / F.nullif(width, F.lit(0.0)) * 255)).cast("int")).alias("codes"), low.alias("low"), width.alias("width"))


def sq8_back(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: c / F.lit(255.0) * q["width"] + q["low"])


def binary(v: Column) -> Column:
    """1 above the middle of the vector's range."""
    v = doubles(v)
    middle = (F.array_min(v) + F.array_max(v)) / 2
    return F.transform(v, lambda x: F.when(x > middle, 1).otherwise(0))


def binary_back(bits: Column) -> Column:
    return F.transform(bits, lambda b: b * 2.0 - 1)


def value_range(df: DataFrame, vector: str = "embedding") -> tuple[float, float]:
    r = df.select(F.array_min(doubles(F.col(vector))).alias("a"), F.array_max(doubles(F.col(vector))).alias("z")).agg(F.min("a"), F.max("z")).first()
    return r[0], r[1]


def global_codes(v: Column, low: float, high: float, bits: int) -> Column:
    """Rounded, clamped codes by one range for all vectors."""
    levels = (1 << bits) - 1
    return F.transform(doubles(v), lambda x: F.greatest(F.lit(0), F.least(F.lit(levels), F.round((x - low) / (high - low) * levels).cast("int"))))


def global_back(codes: Column, low: float, high: float, bits: int) -> Column:
    return F.transform(codes, lambda c: c / F.lit(float((1 << bits) - 1)) * (high - low) + low)


def packed(codes: Column, bits: int) -> Column:
    """Bytes that hold 8 / bits codes each, low bits first."""
    per = 8 // bits
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(codes) - 1) / per).cast("int")), lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(per - 1)), F.lit(0), lambda a, j: a + F.coalesce(F.get(codes, k * per + j), F.lit(0)) * F.pow(F.lit(2), j * bits).cast("int")))


def middle_value(df: DataFrame, vector: str = "embedding", bins: int = 4096) -> float:
    """Element n / 2 of all finite components in order (0 if there are none): the range that holds it
    is parted into ``bins`` by partial counts, and its bin again, until one value is left in it."""
    values = df.select(F.explode(doubles(F.col(vector))).alias("x")).where(~F.isnan("x") & (F.abs("x") < float("inf")))
    low, high, total = values.agg(F.min("x"), F.max("x"), F.count("*")).first()
    before = total // 2
    while total and low < high:
        step = high / bins - low / bins
        own = F.least(F.floor((F.col("x") - low) / step), F.lit(bins - 1)) if step > 0 else (F.col("x") > low).cast("int")
        held = values.where(F.col("x").between(low, high)).groupBy(own.alias("bin")).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
        for part in held.orderBy("bin").collect():  # a row a bin
            if before < part["n"]:
                low, high = part["low"], part["high"]
                break
            before -= part["n"]
    return low if total else 0.0


def above(v: Column, threshold: float) -> Column:
    return F.transform(doubles(v), lambda x: F.when(x > threshold, 1).otherwise(0))


def hamming_similarity(a: Column, b: Column) -> Column:
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return 1 - differ / F.size(a)


def squared_error(v: Column, back: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(v), back, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(v)


def product_train(df: DataFrame, parts: int, codes: int, vector: str = "embedding", seed: int = 42) -> DataFrame:
    """A codebook (part, code, centroid): k-means of each sub-space with a fixed seed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    if some is None:
        return df.sparkSession.createDataFrame([], "part int, code int, centroid array<double>")
    width = -(-some[0] // parts)
    rows = []
    for p in range(parts):
        some = df.select(array_to_vector(F.slice(doubles(F.col(vector)), p * width + 1, width)).alias("features"))
        model = KMeans(k=codes, seed=seed, maxIter=20).fit(some)
        rows += [(p, c, [float(x) for x in center]) for c, center in enumerate(model.clusterCenters())]
    return df.sparkSession.createDataFrame(rows, "part int, code int, centroid array<double>")


def product_encode(df: DataFrame, book: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, part, code and error: the nearest centroid of each part, the smaller code of equals."""
    first = book.agg(F.max(F.size("centroid")).alias("w"), F.max("part").alias("p")).first()
    parts = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(first["p"]))).alias("part"), doubles(F.col(vector)).alias("v")).withColumn("sub", F.slice("v", F.col("part") * first["w"] + 1, F.lit(first["w"]))).drop("v")
    gap = F.aggregate(F.zip_with("sub", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    best = parts.join(F.broadcast(book), "part").groupBy(key, "part").agg(F.min(F.struct(gap.alias("error"), "code")).alias("b"))
    return best.select(key, "part", F.col("b.code").alias("code"), F.col("b.error").alias("error"))
