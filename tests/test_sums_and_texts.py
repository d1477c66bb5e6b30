"""Queries on tables where the order of rows or the length of texts matters."""

import itertools

import duckdb
from pyspark.sql import functions as F

from gridloom.functions import sqlcompat
from gridloom.operators import texttable
from gridloom.plans import registry


def test_compact_numbers_of_sums_in_any_order_of_rows(spark, tmp_path):
    # as doubles, some orders of these prices sum up to less than 799,850; the last customer's sum passes 999.95 million
    orders = list(itertools.permutations([31094.1, 336408.42, 156542.42, 275805.06]))
    assert min(((a + b) + c) + d for a, b, c, d in orders) < 799850.0
    rows = [(k, float(p)) for k, order in enumerate(orders) for p in order] + [(1000, 1.0e9), (1000, 0.5), (1001, 1e25), (1002, None)]
    spark.createDataFrame(rows, "o_custkey bigint, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_custkey: r.short for r in registry.QUERIES["compact_numbers"](spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(len(orders))] == ["799.9K"] * len(orders)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet') WHERE o_custkey IN (1000, 1002)")
    assert {k: got[k] for k in (1000, 1002)} == dict(con.execute(registry.ORACLES["compact_numbers"]).fetchall())


def test_exact_sum_of_values_that_decimals_do_not_hold(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2), (2, 1e-12), (2, 1e-12), (3, 1e30), (4, float("inf")), (5, None)], "k int, x double")
    got = {r.k: r.s for r in df.groupBy("k").agg(sqlcompat.exact_sum(F.col("x")).alias("s")).collect()}
    assert got == {1: 0.3, 2: 2e-12, 3: 1e30, 4: float("inf"), 5: None}


def test_text_round_trip_of_one_long_text(spark, tmp_path, monkeypatch):
    """All customers of a nation are one text, also where it is longer than a stretch."""
    monkeypatch.setattr(texttable, "SEGMENT", 128)
    customers = spark.range(700).select(
        F.col("id").alias("c_custkey"), F.when(F.col("id") < 600, 3).otherwise(F.col("id") % 7).cast("int").alias("c_nationkey"), F.concat(F.lit("Customer "), F.col("id").cast("string")).alias("c_name"), F.lit("BUILDING").alias("c_mktsegment")
    )
    customers.repartition(5).write.parquet(str(tmp_path / "customer.parquet"))
    got = registry.QUERIES["text_round_trip"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.ORACLES["text_round_trip"]).fetchall())
    assert max(r.row_no for r in got if r.id == 3) > 600
