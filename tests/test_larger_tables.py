"""Catalogue queries on tables with keys or shares that only larger copies of the driver's tables have."""

import time

import duckdb
from pyspark.sql import functions as F

from tessera import catalogue


def same_as_sql(spark, d, name, **tables):
    db = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{d}/{t}.parquet")
        db.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    df = catalogue.queries()[name](spark, str(d))
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    want = db.execute(f"select {', '.join(cols)} from ({catalogue.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(repr, want)) and got


def test_what_if_where_the_supposed_manager_is_a_customer(spark, tmp_path):
    keys = [*range(20), 77777, 38888, 19444, 9722]
    same_as_sql(spark, tmp_path, "what_if", customer=spark.createDataFrame([(k,) for k in keys], "c_custkey long"))


def test_means_over_many_derivations(spark, tmp_path):
    # 40,000 derivations of one fact: pair by pair that would be 800 million comparisons
    rows = spark.range(40_000).selectExpr("id as c_custkey", "cast(0 as int) as c_nationkey")
    start = time.time()
    same_as_sql(spark, tmp_path, "carrier_derive", customer=rows)
    assert time.time() - start < 60


def test_distinct_sorted(spark):
    from tessera.plans.semiring import distinct_sorted

    df = spark.createDataFrame([([("b", 1.0), ("a", 2.0), ("b", 1.0), ("a", 1.0)],), ([],)], "w array<struct<id:string,conf:double>>")
    assert [[tuple(x) for x in r[0]] for r in df.select(distinct_sorted(F.col("w"))).collect()] == [[("a", 1.0), ("a", 2.0), ("b", 1.0)], []]
