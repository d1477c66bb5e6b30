"""The SQL surface (Q01-Q26) on temporary views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import sqlcompat
from gridloom.plans.book import Book, table
from gridloom.sources import tables

BOOK = Book()


def _views(spark, sf_dir, *names):
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(f"v_{name}")


SEGMENTS = "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {v}orders JOIN {v}customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment HAVING count(*) > 1 ORDER BY total DESC"


@BOOK.add(SEGMENTS.format(v=""))
def sql_select(spark, sf_dir):
    _views(spark, sf_dir, "orders", "customer")
    return tables.fetch_query(spark, SEGMENTS.format(v="v_"))


CTE = """WITH spent AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM {v}orders GROUP BY 1), top AS (SELECT * FROM spent WHERE total > (SELECT avg(total) FROM spent))
SELECT c_custkey, c_name, total FROM top JOIN {v}customer c ON c_custkey = o_custkey WHERE EXISTS (SELECT 1 FROM {v}nation n WHERE n.n_nationkey = c.c_nationkey AND n_regionkey < 3)"""


@BOOK.add(CTE.format(v=""))
def cte_subquery(spark, sf_dir):
    _views(spark, sf_dir, "orders", "customer", "nation")
    return tables.fetch_query(spark, CTE.format(v="v_"))


CUBE = """SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INTEGER) AS g, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM {v}lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"""


@BOOK.add(CUBE.format(v=""))
def rollup_cube(spark, sf_dir):
    _views(spark, sf_dir, "lineitem")
    return tables.fetch_query(spark, CUBE.format(v="v_"))


GROUPING = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {v}orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"


@BOOK.add(GROUPING.format(v=""))
def grouping_sets(spark, sf_dir):
    _views(spark, sf_dir, "orders")
    return tables.fetch_query(spark, GROUPING.format(v="v_"))


UNIONS = """SELECT 'union' AS kind, k FROM (SELECT c_nationkey AS k FROM {v}customer UNION SELECT s_nationkey FROM {v}supplier)
UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM {v}customer INTERSECT SELECT s_nationkey FROM {v}supplier)
UNION ALL SELECT 'except', k FROM (SELECT n_nationkey AS k FROM {v}nation EXCEPT SELECT s_nationkey FROM {v}supplier WHERE s_nationkey > 10)
UNION ALL SELECT 'all', k FROM (SELECT s_nationkey AS k FROM {v}supplier UNION ALL SELECT n_nationkey FROM {v}nation)"""


@BOOK.add(UNIONS.format(v=""))
def set_ops(spark, sf_dir):
    _views(spark, sf_dir, "customer", "supplier", "nation")
    return tables.fetch_query(spark, UNIONS.format(v="v_"))


@BOOK.add("SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def string_agg(spark, sf_dir):
    _views(spark, sf_dir, "nation", "region")
    return spark.sql("SELECT r_name, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS nations FROM v_nation JOIN v_region ON n_regionkey = r_regionkey GROUP BY r_name")


@BOOK.add("SELECT n_regionkey, array_to_string(list_sort(array_agg(n_nationkey)), ',') AS keys, CAST(count(*) AS INTEGER) AS size FROM nation GROUP BY 1")
def array_agg(spark, sf_dir):
    keys = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("k"))
    return keys.select("n_regionkey", F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("keys"), F.size("k").alias("size"))


@BOOK.add(
    """SELECT p_partkey, substring(p_name, 2, 3) AS mid, concat(p_brand, nullif(p_brand, p_brand), 'x') AS glued, trim('  ' || p_name || ' ') AS trimmed, ltrim(' ' || p_brand) AS lt, rtrim(p_brand || '  ') AS rt,
    replace(p_type, 'A', 'aa') AS replaced, split_part(p_name, ' ', 2) AS second, split_part(p_name, ' ', 9) AS ninth FROM part"""
)
def sql_strings(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.substring("p_name", 2, 3).alias("mid"), F.concat_ws("", "p_brand", F.nullif("p_brand", F.col("p_brand")), F.lit("x")).alias("glued"), F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"),
        F.ltrim(F.concat(F.lit(" "), "p_brand")).alias("lt"), F.rtrim(F.concat("p_brand", F.lit("  "))).alias("rt"), F.replace("p_type", F.lit("A"), F.lit("aa")).alias("replaced"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("second"), F.split_part("p_name", F.lit(" "), F.lit(9)).alias("ninth"),
    )


@BOOK.add(
    """SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '1998-12-31 12:00:00') AS days, date_diff('month', o_orderdate, TIMESTAMP '1998-12-31 12:00:00') AS months, date_diff('year', o_orderdate, TIMESTAMP '1998-12-31 12:00:00') AS years,
    CAST(extract('year' FROM o_orderdate) AS INTEGER) AS y, CAST(extract('month' FROM o_orderdate) AS INTEGER) AS m, strftime(o_orderdate, '%Y/%m/%d at %H:%M') AS text FROM orders"""
)
def date_fns(spark, sf_dir):
    d, end = F.col("o_orderdate"), F.lit("1998-12-31 12:00:00").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", sqlcompat.date_diff("day", d, end).alias("days"), sqlcompat.date_diff("month", d, end).alias("months"), sqlcompat.date_diff("year", d, end).alias("years"), F.year(d).alias("y"), F.month(d).alias("m"), sqlcompat.strftime(d, "%Y/%m/%d at %H:%M").alias("text")
    )


@BOOK.add("SELECT o_orderkey, date_part('year', a) * 12 + date_part('month', a) AS months, date_part('day', a) AS days FROM (SELECT o_orderkey, age(TIMESTAMP '1999-01-01', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS a FROM orders)")
def age_parts(spark, sf_dir):
    months, days = sqlcompat.age(F.lit("1999-01-01").cast("timestamp"), F.col("o_orderdate").cast("date").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", months.alias("months"), days.alias("days"))


@BOOK.add(
    """SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice * (1 - l_discount), 6) AS net, CAST(ceil(l_tax * 100 - 0.5) AS BIGINT) AS up, CAST(floor(l_extendedprice) AS BIGINT) AS down, abs(l_discount - 0.05) AS off,
    power(l_quantity, 2) AS squared, sqrt(l_quantity) AS root, l_orderkey % 7 AS rest FROM lineitem"""
)
def math_fns(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6).alias("net"), F.ceil(F.col("l_tax") * 100 - 0.5).alias("up"), F.floor("l_extendedprice").alias("down"),
        F.abs(F.col("l_discount") - 0.05).alias("off"), F.pow("l_quantity", F.lit(2.0)).alias("squared"), F.sqrt("l_quantity").alias("root"), (F.col("l_orderkey") % 7).alias("rest"),
    )


@BOOK.add(
    """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status,
    greatest(o_orderkey, o_custkey) AS most, least(o_orderkey, o_custkey) AS least FROM orders"""
)
def cond_fns(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(price > 200000, "high").when(price > 100000, "mid").otherwise("low").alias("band"), F.coalesce(F.nullif("o_orderstatus", F.lit("O")), F.lit("open")).alias("status"),
        F.greatest("o_orderkey", "o_custkey").alias("most"), F.least("o_orderkey", "o_custkey").alias("least"),
    )


@BOOK.add(
    """SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)"""
)
def win_rank(spark, sf_dir):
    part = Window.partitionBy("o_custkey")
    by = part.orderBy("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.row_number().over(part.orderBy("o_orderpriority", "o_orderkey")).cast("bigint").alias("rn"), F.rank().over(by).cast("bigint").alias("rk"), F.dense_rank().over(by).cast("bigint").alias("dr")
    )


@BOOK.add("SELECT event_id, lag(event_type) OVER w AS before, lead(event_type, 2, 'none') OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def win_lag(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_type").over(by).alias("before"), F.lead("event_type", 2, "none").over(by).alias("after"))


@BOOK.add(
    """SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS f, last_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS l,
    count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near FROM events"""
)
def win_frame(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("event_id")
    rows = by.rowsBetween(-3, 1)
    return table(spark, sf_dir, "events").select("event_id", F.first("event_id").over(rows).alias("f"), F.last("event_id").over(rows).alias("l"), F.count("*").over(by.rangeBetween(-500, 0)).alias("near"))


@BOOK.add("SELECT count(*) AS n, count(*) FILTER (d >= DATE '2024-01-01') AS recent FROM (SELECT current_date AS d FROM nation)")
def current_day(spark, sf_dir):
    days = table(spark, sf_dir, "nation").select(F.current_date().alias("d"))
    return days.agg(F.count("*").alias("n"), F.count_if(F.col("d") >= F.lit("2024-01-01").cast("date")).alias("recent"))
