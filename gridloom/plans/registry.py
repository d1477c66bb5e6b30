"""All queries of the table operators, with their oracles, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.operators import order, search
from gridloom.plans import columns_queries, edit_queries, frame_queries, search_queries, source_queries, sql_queries, text_queries

_MODULES = (search_queries, columns_queries, edit_queries, frame_queries, sql_queries, text_queries, source_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.BOOK.queries.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.BOOK.oracles.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of middling price, sorted on two keys, the first hundred."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = search.find(orders, "o_totalprice", "between", "1000", "50000")
    return order.head(found, [("o_orderpriority", True), ("o_orderkey", True)], 100)
