"""The pipeline: its stages one by one, and run() against them."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quillon.llm import decontaminate, jaccard, pii
from tests.llm.conftest import SMALL
from tests.llm.test_operators import base, linked, texts


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["language", "jaccard", "decontamination", "pii", "mixing"]
    one = stages["language"](spark, docs, SMALL).cache()
    assert one.columns == docs.columns and one.count() == docs.count()
    two = stages["jaccard"](spark, one, SMALL).cache()
    assert set(texts(two)) == {k for k, (_, c) in linked(texts(one)).items() if c == k}
    three = stages["decontamination"](spark, two, SMALL).cache()
    assert three.columns == docs.columns and not decontaminate.find(three, bench).where("contaminated").count()
    hit = {r["doc_id"] for r in decontaminate.find(two, bench).where("contaminated").collect()}
    assert {k: t for k, t in texts(three).items() if k not in hit} == {k: t for k, t in texts(two).items() if k not in hit}
    four = stages["pii"](spark, three, SMALL).cache()
    assert four.columns == docs.columns and not any(base(t) for t in texts(four).values())
    assert four.where("n_chars <> length(text)").count() == 0
    five = stages["mixing"](spark, four, SMALL)
    assert sorted(map(tuple, five.collect())) == sorted(map(tuple, pipeline.run(spark, SMALL).collect()))


def test_odd_rows(spark, odd, empty):
    for name, stage in pipeline.STAGES:
        out = stage(spark, odd.select("doc_id", "text", "lang", "source", "n_chars"), SMALL)
        assert out.count() >= 4, name
        assert stage(spark, empty.select("doc_id", "text", "lang", "source", "n_chars"), SMALL).count() == 0, name


def test_near_copies_keep_one(spark):
    words = [f"w{i}" for i in range(100)]
    df = spark.createDataFrame([(i, " ".join(words[: 97 + i % 3])) for i in range(1, 30)], "doc_id long, text string")
    assert [r["component_id"] for r in jaccard.join(df).select("component_id").distinct().collect()] == [1]
    assert pii.find(df).where(F.size("spans") > 0).count() == 0


def test_jaccard_stage_keeps_one_row_a_group(spark):
    """Whatever ids are null or repeated: of each group one row, the first id's."""
    same, other, third = (" ".join(f"{c}{i}" for i in range(30)) for c in "wvu")
    rows = [(9, same), (None, same), (5, same), (5, same), (5, other), (7, other), (None, third), (None, third), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(pipeline.STAGES)["jaccard"](spark, df, SMALL)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([(5, same), (5, other), (None, third), (8, None)], df.schema).collect()))
