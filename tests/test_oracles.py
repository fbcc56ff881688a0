"""Every query of the library with SQL, against DuckDB, at the smallest size."""

import math

import duckdb
import pytest

from quillon.plans import QUERIES, SQL
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v if isinstance(v, (int, bool)) or v is None else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    own = sorted(df.columns)
    rows = sorted(str(tuple(plain(r[c]) for c in own)) for r in df.collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == own
    at = [rel.columns.index(c) for c in own]
    assert rows == sorted(str(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


def test_every_query_without_sql_has_rows(spark):
    for name in sorted(set(QUERIES) - set(SQL) - {"z6_product_codes", "g4_shortest_path"}):
        assert QUERIES[name](spark, SMALL).take(1), name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
