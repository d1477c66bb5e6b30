"""Search, sort and paging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import scratch
from gridloom.operators import order, search
from gridloom.plans.book import Book, table

BOOK = Book()
NUMERIC = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


@BOOK.add("SELECT row_number() OVER (ORDER BY o_orderkey) AS _row, o_orderkey, o_totalprice FROM orders ORDER BY 1 LIMIT 1000")
def page_after_reset(spark, sf_dir):
    """The first page of a table that was sorted by price and then put back into its own order."""
    indexed = order.with_row_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [("o_orderkey", True)])
    back = order.reset(order.sort(indexed, [("o_totalprice", False), ("o_orderkey", True)]))
    return back.limit(order.PAGE)


@BOOK.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def find_equals(spark, sf_dir):
    return search.find(table(spark, sf_dir, "orders"), "o_orderstatus", "equals", "F").select("o_orderkey", "o_orderstatus")


@BOOK.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def find_not_equals(spark, sf_dir):
    return search.find(table(spark, sf_dir, "orders"), "o_orderstatus", "not_equals", "F").select("o_orderkey", "o_orderstatus")


def _line(spark, sf_dir, kind, *values):
    return search.find(table(spark, sf_dir, "lineitem"), "l_quantity", kind, *values).select("l_orderkey", "l_linenumber", "l_quantity")


@BOOK.add("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40")
def find_gt(spark, sf_dir):
    return _line(spark, sf_dir, "gt", "40")


@BOOK.add("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 40")
def find_ge(spark, sf_dir):
    return _line(spark, sf_dir, "ge", "40")


@BOOK.add("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 7")
def find_lt(spark, sf_dir):
    return _line(spark, sf_dir, "lt", "7")


@BOOK.add("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <= 7")
def find_le(spark, sf_dir):
    return _line(spark, sf_dir, "le", "7")


@BOOK.add("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def find_between(spark, sf_dir):
    return _line(spark, sf_dir, "between", "10", "12")


@BOOK.add("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 3 OR l_quantity > 48")
def find_outside(spark, sf_dir):
    return _line(spark, sf_dir, "outside", "3", "48")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("event_type", F.nullif("event_type", F.lit("error")))


@BOOK.add("SELECT event_id, user_id FROM events WHERE nullif(event_type, 'error') IS NULL")
def find_null(spark, sf_dir):
    return search.find(_events(spark, sf_dir), "event_type", "is_null").select("event_id", "user_id")


@BOOK.add("SELECT event_id, event_type FROM events WHERE nullif(event_type, 'error') IS NOT NULL")
def find_not_null(spark, sf_dir):
    return search.find(_events(spark, sf_dir), "event_type", "is_not_null").select("event_id", "event_type")


@BOOK.add(
    rf"""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS v FROM part)
    SELECT p_partkey, v FROM t WHERE CASE WHEN regexp_matches(v, '{NUMERIC}') THEN TRY_CAST(v AS DOUBLE) > 9 ELSE v > '9' END"""
)
def find_text_numeric_mix(spark, sf_dir):
    mixed = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("v"))
    return search.find(mixed, "v", "gt", "9")


ORDERED = "SELECT row_number() OVER (ORDER BY o_orderkey) AS r, * FROM orders"


def _indexed(spark, sf_dir):
    return order.with_row_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), [("o_orderkey", True)])


@BOOK.add(f"""SELECT CAST(r AS BIGINT) AS "row", CAST(2 AS INTEGER) AS col, 'C' || CAST(r + 1 AS VARCHAR) AS address, o_orderstatus AS value FROM ({ORDERED}) WHERE o_orderstatus = 'P'""")
def find_addresses(spark, sf_dir):
    return search.find_cells(_indexed(spark, sf_dir), "o_orderstatus", "equals", "P")


@BOOK.add(
    f"""WITH hits AS (SELECT CAST(r AS BIGINT) AS "row" FROM ({ORDERED}) WHERE o_custkey % 97 = 5)
    SELECT "row", coalesce(lead("row") OVER (ORDER BY "row"), min("row") OVER ()) AS next_row, coalesce(lag("row") OVER (ORDER BY "row"), max("row") OVER ()) AS previous_row FROM hits"""
)
def find_next(spark, sf_dir):
    rows = _indexed(spark, sf_dir).withColumn("hit", (F.col("o_custkey") % 97 == 5).cast("string"))
    return search.with_neighbours(search.find_cells(rows, "hit", "equals", "true")).select("row", "next_row", "previous_row")


@BOOK.add(f"""SELECT CAST(r AS BIGINT) AS "row", CAST(0 AS INTEGER) AS col FROM ({ORDERED}) WHERE o_orderstatus = 'P' ORDER BY abs(r - 500) + 0, r LIMIT 1""".replace("CAST(0", "CAST(2"))
def find_nearest(spark, sf_dir):
    return search.nearest(search.find_cells(_indexed(spark, sf_dir), "o_orderstatus", "equals", "P"), 500, 2).select("row", "col")


@BOOK.add(
    """SELECT o_orderkey, o_custkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders
    ORDER BY nullif(o_orderpriority, '5-LOW') DESC NULLS FIRST, o_custkey ASC NULLS FIRST, o_orderkey LIMIT 200"""
)
def sort_multi_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    keys = order.toggled(order.toggled(order.toggled(order.toggled([], "priority"), "priority"), "o_custkey"), "o_orderkey")
    return order.head(rows, keys, 200)


@BOOK.add(
    """WITH t AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS r, count(*) OVER () AS n FROM orders),
    s AS (SELECT *, greatest(0, least(n // 2 - 1 - 500, n - 1000)) AS start FROM t)
    SELECT CAST(r AS BIGINT) AS _row, o_orderkey, o_orderpriority FROM s WHERE r BETWEEN start + 1 AND start + 1000"""
)
def page_middle(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    stored = order.store(orders, [("o_orderpriority", True), ("o_orderkey", True)], scratch.new_path(spark, "order"), 4096)
    return stored.page(stored.total // 2)


@BOOK.add("SELECT CAST(r AS BIGINT) AS _row, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE o_totalprice BETWEEN 20000 AND 30000")
def rows_by_key(spark, sf_dir):
    """The numbered rows of a stretch of the first key, by the ranges that hold it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    stored = order.store(orders, [("o_totalprice", False), ("o_orderkey", True)], scratch.new_path(spark, "order"), 4096)
    return stored.around(20000.0, 30000.0)


@BOOK.add(f"""SELECT CAST(r AS BIGINT) AS "row", CAST(1 AS INTEGER) AS col, 'B' || CAST(r + 1 AS VARCHAR) AS address, CAST(o_custkey AS VARCHAR) AS value FROM ({ORDERED}) WHERE r BETWEEN 700 AND 900 AND o_custkey % 2 = 0""")
def find_on_page(spark, sf_dir):
    """A search of the rows that are in view."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    stored = order.store(orders, [("o_orderkey", True)], scratch.new_path(spark, "order"), 4096)
    return search.find_cells(stored.between(700, 900).filter("o_custkey % 2 = 0"), "o_custkey", "is_not_null")


@BOOK.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 50")
def tail_n(spark, sf_dir):
    return order.tail(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", True)], 50)


@BOOK.add("SELECT CAST(row_number() OVER (ORDER BY c_acctbal DESC NULLS FIRST, c_custkey) AS BIGINT) AS _row, c_custkey FROM customer")
def row_index(spark, sf_dir):
    return order.with_row_index(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [("c_acctbal", False), ("c_custkey", True)]).select("_row", "c_custkey")


@BOOK.add("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 250")
def limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").offset(250).limit(100)


@BOOK.add("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey DESC LIMIT 100")
def sort_toggled(spark, sf_dir):
    """Keys as clicks make them: a second click on a key turns it, keys of columns that are gone fall away."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    keys = order.toggled(order.toggled(order.toggled([("gone", True)], "o_orderpriority"), "o_orderkey"), "o_orderkey")
    return order.head(orders, order.valid(keys, orders.columns), 100)


@BOOK.add("SELECT count(*) AS _row, max(o_orderkey) AS o_orderkey FROM orders")
def last_row(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    rows = order.with_row_index(orders, [("o_orderkey", True)])
    return rows.filter(F.col("_row") == order.resolve_row(-1, orders.count()))
