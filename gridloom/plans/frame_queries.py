"""Joins, reshaping, distinct rows and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import sqlcompat
from gridloom.operators import frame, ranks
from gridloom.plans.book import Book, table

BOOK = Book()


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def _rich(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select("c_custkey", "c_name")


RICH = "(SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000) c"


@BOOK.add(f"SELECT o_orderkey, o_custkey, o_totalprice, c_name FROM orders JOIN {RICH} ON o_custkey = c_custkey")
def join_inner(spark, sf_dir):
    return frame.join(_orders(spark, sf_dir), _rich(spark, sf_dir), ["o_custkey"], ["c_custkey"], validate="m:1")


@BOOK.add(f"SELECT o_orderkey, o_custkey, o_totalprice, c_name FROM orders LEFT JOIN {RICH} ON o_custkey = c_custkey")
def join_left(spark, sf_dir):
    return frame.join(_orders(spark, sf_dir), _rich(spark, sf_dir), ["o_custkey"], ["c_custkey"], "left")


@BOOK.add("SELECT o_orderkey, c_custkey AS o_custkey, o_totalprice, c_name FROM (SELECT * FROM orders WHERE o_totalprice > 100000) o RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(spark, sf_dir):
    return frame.join(_orders(spark, sf_dir).filter("o_totalprice > 100000"), table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["o_custkey"], ["c_custkey"], "right")


@BOOK.add(f"SELECT o_orderkey, coalesce(o_custkey, c_custkey) AS o_custkey, o_totalprice, c_name FROM (SELECT * FROM orders WHERE o_totalprice > 100000) o FULL JOIN {RICH} ON o_custkey = c_custkey")
def join_full(spark, sf_dir):
    return frame.join(_orders(spark, sf_dir).filter("o_totalprice > 100000"), _rich(spark, sf_dir), ["o_custkey"], ["c_custkey"], "full")


@BOOK.add(f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM {RICH})")
def join_semi(spark, sf_dir):
    return frame.join(_orders(spark, sf_dir), _rich(spark, sf_dir), ["o_custkey"], ["c_custkey"], "semi")


@BOOK.add(f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {RICH})")
def join_anti(spark, sf_dir):
    return frame.join(_orders(spark, sf_dir), _rich(spark, sf_dir), ["o_custkey"], ["c_custkey"], "anti")


@BOOK.add("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, sf_dir):
    return frame.join(table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name"), [], [], "cross")


@BOOK.add(
    """SELECT count(*) AS n FROM (SELECT nullif(event_type, 'error') AS k FROM events) a
    JOIN (SELECT DISTINCT nullif(event_type, 'error') AS k FROM events) b ON a.k IS NOT DISTINCT FROM b.k"""
)
def join_nulls(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("k"))
    return frame.join(keys, keys.select("k").distinct(), ["k"], join_nulls=True).agg(F.count("*").alias("n"))


@BOOK.add(
    """SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS BIGINT) AS "F", CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS BIGINT) AS "O", CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS BIGINT) AS "P" FROM orders GROUP BY 1"""
)
def pivot_status(spark, sf_dir):
    return frame.pivot(table(spark, sf_dir, "orders"), "o_orderstatus", ["o_custkey"], F.sum(F.lit(1).cast("bigint")), ["F", "O", "P"])


@BOOK.add("SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot_prices(spark, sf_dir):
    return frame.unpivot(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_partkey"], ["p_size", "p_retailprice"])


@BOOK.add("""SELECT 'r_regionkey' AS key, max(CASE WHEN r_name = 'AFRICA' THEN r_regionkey END) AS "AFRICA", max(CASE WHEN r_name = 'AMERICA' THEN r_regionkey END) AS "AMERICA", max(CASE WHEN r_name = 'ASIA' THEN r_regionkey END) AS "ASIA",
    max(CASE WHEN r_name = 'EUROPE' THEN r_regionkey END) AS "EUROPE", max(CASE WHEN r_name = 'MIDDLE EAST' THEN r_regionkey END) AS "MIDDLE EAST" FROM region""")
def transpose_region(spark, sf_dir):
    return frame.transpose(table(spark, sf_dir, "region").select("r_name", "r_regionkey"), "r_name")


def _kept(order):
    return f"SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {order}) AS k FROM events) WHERE k = 1"


@BOOK.add(_kept("event_id"))
def unique_first(spark, sf_dir):
    return frame.unique(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "first", "event_id")


@BOOK.add(_kept("event_id DESC"))
def unique_last(spark, sf_dir):
    return frame.unique(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "last", "event_id")


@BOOK.add("SELECT l_orderkey, l_returnflag, l_linestatus, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus) AS k FROM lineitem) WHERE k = 1")
def unique_none(spark, sf_dir):
    return frame.unique(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_partkey"), ["l_orderkey", "l_returnflag", "l_linestatus"], "none")


@BOOK.add("SELECT DISTINCT user_id, event_type FROM events")
def unique_any(spark, sf_dir):
    return frame.unique(table(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@BOOK.add("SELECT user_id, count(DISTINCT nullif(event_type, 'error')) + max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS n FROM events GROUP BY 1")
def n_unique(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(sqlcompat.n_unique(F.nullif("event_type", F.lit("error"))).alias("n"))


@BOOK.add(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, max(l_discount) AS max_disc, min(l_tax) AS min_tax, count(l_orderkey) AS n, count(*) AS len,
    median(l_quantity) AS med, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS var, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2"""
)
def agg_all(spark, sf_dir):
    plain = [
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.max("l_discount").alias("max_disc"), F.min("l_tax").alias("min_tax"), F.count("l_orderkey").alias("n"), F.count("*").alias("len"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.var_samp("l_quantity"), 6).alias("var"),
    ]
    return frame.aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], plain, {"med": "l_quantity"}, {"suppliers": "l_suppkey"})


@BOOK.add(
    """SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.25), 4) AS low, round(quantile_cont(l_extendedprice, 0.75), 4) AS high FROM lineitem GROUP BY 1"""
)
def quartiles(spark, sf_dir):
    """Interpolated quartiles of many groups."""
    rows = table(spark, sf_dir, "lineitem")
    low, high = (ranks.quantiles(rows, ["l_suppkey"], ["l_extendedprice"], q, "linear").select("l_suppkey", F.round("quantile", 4).alias(name)) for q, name in ((0.25, "low"), (0.75, "high")))
    return low.join(high, "l_suppkey")


@BOOK.add("SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1")
def first_last(spark, sf_dir):
    first, last = frame.first_last("event_type", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(first.alias("first_type"), last.alias("last_type"))


@BOOK.add(
    """WITH t AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT l_returnflag, v AS quantile FROM t WHERE r = floor(0.9 * (n - 1) + 0.5)"""
)
def quantile_nearest(spark, sf_dir):
    return frame.quantile_nearest(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9)


@BOOK.add(
    """SELECT o.o_orderkey, e.event_id FROM (SELECT o_orderkey, o_custkey AS user_id, o_orderkey * 3 AS t FROM orders) o
    ASOF LEFT JOIN (SELECT user_id, event_id, event_id AS t FROM events) e ON e.user_id = o.user_id AND e.t <= o.t"""
)
def as_of_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") * 3).alias("t"))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("t"))
    return frame.as_of(orders, events, "user_id", "t", "event_id").select("o_orderkey", "event_id")


@BOOK.add("SELECT o_orderkey, p_partkey FROM orders JOIN (SELECT p_partkey, p_partkey * 50 AS lo, p_partkey * 50 + p_size AS hi FROM part) p ON o_orderkey BETWEEN lo AND hi")
def range_join(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 50).alias("lo"), (F.col("p_partkey") * 50 + F.col("p_size")).alias("hi"))
    return frame.range_join(table(spark, sf_dir, "orders").select("o_orderkey"), part, "o_orderkey", "lo", "hi").select("o_orderkey", "p_partkey")


LENGTHS = "SELECT c_custkey, c_custkey * 40 AS lo, c_custkey * 40 + CAST(pow(10, c_custkey % 7) AS BIGINT) * CASE WHEN c_custkey % 50 < 7 THEN 1 ELSE 0 END AS hi FROM customer"


@BOOK.add(f"SELECT c_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders JOIN ({LENGTHS}) c ON o_orderkey BETWEEN lo AND hi GROUP BY 1")
def range_join_lengths(spark, sf_dir):
    """Intervals of one point up to a million."""
    k = F.col("c_custkey")
    length = F.pow(F.lit(10), k % 7).cast("bigint") * F.when(k % 50 < 7, 1).otherwise(0)
    spans = table(spark, sf_dir, "customer").select("c_custkey", (k * 40).alias("lo"), (k * 40 + length).alias("hi"))
    return frame.range_join(table(spark, sf_dir, "orders").select("o_orderkey"), spans, "o_orderkey", "lo", "hi").groupBy("c_custkey").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@BOOK.add(
    """SELECT l.l_orderkey, l.l_linenumber, o.o_totalprice AS price FROM (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_suppkey END AS k FROM lineitem) l
    ASOF LEFT JOIN (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 100 END AS k, o_orderkey AS t, o_totalprice FROM orders) o ON o.k = l.k AND o.t <= l.l_orderkey"""
)
def as_of_hot(spark, sf_dir):
    """One key holds half of the left rows and a third of the right ones."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 2 == 0, 0).otherwise(F.col("l_suppkey")).alias("k"), F.col("l_orderkey").alias("t"))
    orders = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey") % 100).alias("k"), F.col("o_orderkey").alias("t"), F.col("o_totalprice").alias("price"))
    return frame.as_of(lines, orders, "k", "t", "price").select("l_orderkey", "l_linenumber", "price")


@BOOK.add(
    """SELECT p_partkey, contains(p_name, 'a') AS has_a, regexp_matches(p_brand, '[1-3]$') AS low, starts_with(p_brand, 'Brand') AS starts, ends_with(p_type, 'L') AS ends, regexp_replace(p_name, 'a', '<$>') AS once,
    regexp_replace(p_name, '[aeiou]', '_', 'g') AS every, CAST(length(p_name) AS INTEGER) AS chars, CAST(strlen(p_name) AS INTEGER) AS bytes, lower(p_type) AS low_type, upper(p_name) AS up_name, p_brand || '-' || p_type AS joined FROM part"""
)
def string_fns(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").contains("a").alias("has_a"), F.col("p_brand").rlike("[1-3]$").alias("low"), F.col("p_brand").startswith("Brand").alias("starts"), F.col("p_type").endswith("L").alias("ends"),
        sqlcompat.replace_first(F.col("p_name"), "a", "<$>").alias("once"), F.regexp_replace("p_name", "[aeiou]", "_").alias("every"), F.length("p_name").alias("chars"), F.octet_length("p_name").alias("bytes"),
        F.lower("p_type").alias("low_type"), F.upper("p_name").alias("up_name"), sqlcompat.concat_str([F.col("p_brand"), F.col("p_type")], "-").alias("joined"),
    )


@BOOK.add("SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type || '/' || CAST(user_id AS VARCHAR) END AS strict, CASE WHEN event_type = 'error' THEN CAST(user_id AS VARCHAR) ELSE event_type || '/' || CAST(user_id AS VARCHAR) END AS loose FROM events")
def concat_nulls(spark, sf_dir):
    parts = [F.nullif("event_type", F.lit("error")), F.col("user_id").cast("string")]
    return table(spark, sf_dir, "events").select("event_id", sqlcompat.concat_str(parts, "/").alias("strict"), sqlcompat.concat_str(parts, "/", ignore_nulls=True).alias("loose"))


@BOOK.add("SELECT n_nationkey, n_name AS name, n_regionkey AS region, n_nationkey + n_regionkey AS total, CAST(2 AS INTEGER) AS width FROM nation")
def list_struct(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.struct("n_name", "n_regionkey").alias("s"), F.array("n_nationkey", "n_regionkey").alias("l"))
    return rows.select("n_nationkey", F.col("s.n_name").alias("name"), F.col("s.n_regionkey").alias("region"), F.aggregate("l", F.lit(0), lambda a, x: a + x).alias("total"), F.size("l").alias("width"))


@BOOK.add("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS rolling FROM orders")
def rolling_mean(spark, sf_dir):
    recent = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(recent), 4).alias("rolling"))
