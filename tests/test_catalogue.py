"""Catalogue queries against their SQL in DuckDB on the smallest tables, and the entry points' contract."""

import os

import duckdb
import pytest

import __spark_entry__
from tessera import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EVERY = sorted(catalogue.oracle_sql())


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", EVERY)
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    result = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in result.fetchall())


def test_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if os.path.isdir(SF):
        assert __spark_entry__.entry(spark).count() > 0


def test_plans_push_filters_and_prune_columns(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    from tessera.operators.engine import Engine

    e = Engine(spark)
    e.register("customer", spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment"))
    plan = e.ask("customer(X, _, \"BUILDING\")")._jdf.queryExecution().executedPlan().toString()
    assert "c_name" not in plan.split("ReadSchema")[1].split("\n")[0] and "EqualTo(c_mktsegment,BUILDING)" in plan
