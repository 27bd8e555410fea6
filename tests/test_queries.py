"""Every query with SQL gives the same rows as DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from watchloom.plans import queries as core

DIR = "/root/testdata/sf0.001"
SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(DIR + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(str).replace({"None": "~", "nan": "~", "<NA>": "~"})
    return list(df.columns), sorted(map(tuple, df.values))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(core.queries()[name](spark, DIR).toPandas()) == rows(duck.sql(SQL[name]).df())


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["subject", "id", "score", "position"] and df.count() > 0


def test_candidates_need_no_nested_loop(spark):
    plan = core.queries()["bm25_candidates"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
