"""Registered queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tablecraft.plans import catalogue

NAMES = sorted(catalogue.QUERIES)


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return str(round(value, 6)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, tables, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in entry.oracle_sql():
        return
    want = tables.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall()) == got


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_with_where_has_loads_all(spark, sf_dir, tmp_path):
    n = 1_000_003
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        if not path.endswith("/orders.parquet"):
            (tmp_path / os.path.basename(path)).symlink_to(path)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    many = spark.range(n).selectExpr("id AS o_orderkey", "id % 3 + 1 AS o_custkey", "'P' AS o_orderstatus", "1D AS o_totalprice")
    many.unionByName(orders.limit(0), allowMissingColumns=True).write.parquet(f"{tmp_path}/orders.parquet")
    got = entry.queries()["with_where_has"](spark, str(tmp_path)).collect()
    assert sorted(r["n"] for r in got) == [n // 3, n // 3, n // 3 + 1]


def test_filters_reach_the_scan(spark, sf_dir):
    for name, pushed in [("filter_year_eq", "GreaterThanOrEqual(o_orderdate"), ("filter_eq", "EqualTo(p_size"), ("filter_like_starts", "StringStartsWith(p_type")]:
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan
