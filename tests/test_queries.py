"""Queries beside their DuckDB twins on the smallest tables, and what the driver needs of the registry."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from darb.plans import data_queries, detail_queries, driver_queries, more_queries, route_queries, run_queries
from verify_sql import rows_of

SF = "/root/testdata/sf0.001"
CORE = {n: (f, m.SQL.get(n)) for m in (route_queries, run_queries, detail_queries, more_queries, driver_queries, data_queries) for n, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", [n for n, (_, sql) in CORE.items() if sql])
def test_equals_sql(spark, duck, name):
    f, sql = CORE[name]
    df, rel = f(spark, SF), duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["mode", "checked", "violations", "violation_pct"] and df.count() > 0
