"""Registered queries against their SQL in DuckDB, as the driver compares them."""

import duckdb
import pytest

import __spark_entry__ as entry
from sagebrush.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    order = sorted(frame.columns)
    return sorted(str([None if v is None or v != v else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in r]) for r in frame[order].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    nulls = lambda f: f.astype(object).where(f.notna(), None)
    assert rows(nulls(got)) == rows(nulls(want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.SQL) <= set(entry.oracle_sql())
