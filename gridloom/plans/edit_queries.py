"""Edit and lineage queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators import edit, order, stages
from gridloom.plans.book import Book, table
from gridloom.scratch import settle

BOOK = Book()
CUSTOMERS = "SELECT row_number() OVER (ORDER BY c_custkey) AS r, c_custkey, c_name, c_nationkey FROM customer"


def _customers(spark, sf_dir):
    return order.with_row_index(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), [("c_custkey", True)])


@BOOK.add(
    """WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS r, o_orderkey, o_totalprice, o_orderstatus FROM orders)
    SELECT CAST(r AS BIGINT) AS _row, o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 10 = 4 THEN CAST(r AS DOUBLE) + 0.5 ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 10 = 4 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM o"""
)
def patch_cells(spark, sf_dir):
    rows = order.with_row_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), [("o_orderkey", True)])
    third, fourth = rows.filter("o_orderkey % 10 = 3"), rows.filter("o_orderkey % 10 = 4")
    one = lambda df, col, value, seq: df.select(F.col("_row").alias("row"), F.lit(col).alias("col"), value.alias("value"), F.lit(seq).alias("seq"))
    patches = one(third, "o_totalprice", F.lit("17"), 1).unionByName(one(third, "o_totalprice", F.lit(None).cast("string"), 2))
    patches = patches.unionByName(one(fourth, "o_totalprice", F.concat(F.col("_row").cast("string"), F.lit(".5")), 3)).unionByName(one(fourth, "o_orderstatus", F.lit("new"), 4))
    return edit.apply_patches(rows, patches)


@BOOK.add(
    f"""WITH t AS ({CUSTOMERS}), u AS (SELECT r + (CASE WHEN r >= 1 THEN 1 ELSE 0 END) + (CASE WHEN r >= 5 THEN 1 ELSE 0 END) AS r, c_custkey, c_name, c_nationkey FROM t
    UNION ALL SELECT 1, NULL, NULL, NULL UNION ALL SELECT 6, NULL, NULL, NULL UNION ALL SELECT count(*) + 3, NULL, NULL, NULL FROM t) SELECT CAST(r AS BIGINT) AS _row, c_custkey, c_name, c_nationkey FROM u"""
)
def insert_rows(spark, sf_dir):
    return edit.insert_rows(_customers(spark, sf_dir), [5, 1, 10**12])


@BOOK.add(f"SELECT CAST(row_number() OVER (ORDER BY r) AS BIGINT) AS _row, c_custkey, c_name, c_nationkey FROM ({CUSTOMERS}) WHERE r NOT IN (1, 7, 25)")
def delete_rows(spark, sf_dir):
    return edit.delete_rows(_customers(spark, sf_dir), [7, 25, 1])


NUMBERED = "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS r, o_orderkey FROM orders"


@BOOK.add(
    f"""WITH t AS ({NUMBERED}), kept AS (SELECT row_number() OVER (ORDER BY r) AS r, o_orderkey FROM t WHERE r % 10 <> 0),
    u AS (SELECT r, 1 AS late, o_orderkey FROM kept UNION ALL SELECT r, 0, NULL FROM kept WHERE r % 10 = 3 UNION ALL SELECT r, 0, NULL FROM kept WHERE r % 100 = 3)
    SELECT CAST(row_number() OVER (ORDER BY r, late) AS BIGINT) AS _row, o_orderkey FROM u"""
)
def edited_at_many_rows(spark, sf_dir):
    """Every tenth order is deleted; of what is left one row, or two, are put in before every tenth: the places are tables."""
    rows = order.with_row_index(table(spark, sf_dir, "orders").select("o_orderkey"), [("o_orderkey", True)])
    kept = settle(edit.delete_rows(rows, rows.filter("_row % 10 = 0").select("_row")), "edited-orders")
    return edit.insert_rows(kept, kept.filter("_row % 10 = 3").select("_row").unionByName(kept.filter("_row % 100 = 3").select("_row")))


@BOOK.add(f"SELECT CAST(r AS BIGINT) AS _row, c_custkey, c_name, c_nationkey FROM ({CUSTOMERS}) UNION ALL SELECT count(*) + 1, NULL, NULL, NULL FROM customer")
def append_row(spark, sf_dir):
    return edit.append_row(_customers(spark, sf_dir))


@BOOK.add('SELECT c_custkey, CAST(NULL AS VARCHAR) AS "Column_1", c_name, CAST(NULL AS VARCHAR) AS "Column_2" FROM customer')
def add_column(spark, sf_dir):
    return edit.add_column(edit.add_column(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 1), 99)


@BOOK.add('SELECT CAST(NULL AS VARCHAR) AS "Column_1" FROM customer')
def delete_last_column(spark, sf_dir):
    return edit.delete_column(edit.delete_column(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 1), 0)


@BOOK.add(
    """SELECT 'replaced' AS sheet, CAST(s_suppkey AS DOUBLE) AS key, s_name AS name, 0 AS steps FROM supplier UNION ALL SELECT 'appended', c_custkey, c_name, 2 FROM customer WHERE c_custkey > 10
    UNION ALL SELECT 'appended', s_suppkey + 0.5, s_name, 2 FROM supplier UNION ALL SELECT 'fresh', s_suppkey, s_name, 0 FROM supplier"""
)
def pasted_rows(spark, sf_dir):
    """Rows pasted over a sheet, behind the rows of one, whose keys become fractions, and as a sheet of their own."""
    customer, supplier = table(spark, sf_dir, "customer").selectExpr("c_custkey as key", "c_name as name"), table(spark, sf_dir, "supplier").selectExpr("s_suppkey as key", "s_name as name")
    book = stages.Workbook(spark)
    for name in ("replaced", "appended"):
        book.add(name, customer)
        book.apply(name, lambda df: df.filter("key > 10"), "without the first", track=False)
    book.paste("replaced", supplier)
    book.paste("appended", supplier.selectExpr("key + double(0.5) as key", "name"), "append")
    book.paste("fresh", supplier, "new")
    found = [s.df.select(F.lit(n).alias("sheet"), F.col("key").cast("double").alias("key"), "name", F.lit(len(s.steps)).alias("steps")) for n, s in book.stages.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


@BOOK.add("""SELECT column_name AS "column", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date' ELSE 'timestamp' END AS type, 0 AS empty FROM (DESCRIBE SELECT *, o_totalprice > 5 AS dear FROM orders) WHERE column_name <> 'dear' UNION ALL SELECT 'dear', 'boolean', 0""")
def sheet_schema(spark, sf_dir):
    """A sheet's columns after a step, beside a sheet without data, which has none."""
    book = stages.Workbook(spark)
    book.add("orders", table(spark, sf_dir, "orders"))
    book.apply("orders", "SELECT *, o_totalprice > 5 AS dear FROM {df}", track=False)
    empty = len(book.add("empty").schema())
    return spark.createDataFrame([(c, k.removesuffix("_ntz"), empty) for c, k in book.get("orders").schema().items()], "column string, type string, empty int")


@BOOK.add("SELECT c_custkey AS customer_id, c_name FROM customer")
def rename_column(spark, sf_dir):
    return edit.rename_column(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "customer_id")


@BOOK.add(f"SELECT CAST(r AS BIGINT) AS _row, CASE WHEN r = 3 THEN 12.75 ELSE CAST(c_nationkey AS DOUBLE) END AS c_nationkey FROM ({CUSTOMERS})")
def typed_edit(spark, sf_dir):
    return edit.edit_cell(_customers(spark, sf_dir).select("_row", "c_nationkey"), 3, "c_nationkey", "12.75", convert_column=True)


PRICES = "SELECT row_number() OVER (ORDER BY o_orderkey) AS r, o_totalprice, o_custkey FROM orders"


def _prices(spark, sf_dir, column):
    rows = order.with_row_index(table(spark, sf_dir, "orders").select("o_orderkey", column), [("o_orderkey", True)])
    return rows.select("_row", column)


@BOOK.add(f"SELECT CAST(r AS BIGINT) AS _row, CASE WHEN r = 2 THEN 5.0 ELSE o_totalprice END AS o_totalprice FROM ({PRICES})")
def typed_edit_whole(spark, sf_dir):
    """A whole number leaves a column of floats as it is."""
    return edit.edit_cell(_prices(spark, sf_dir, "o_totalprice"), 2, "o_totalprice", "5", convert_column=True)


@BOOK.add(f"SELECT CAST(r AS BIGINT) AS _row, CASE WHEN r = 2 THEN 1 ELSE o_custkey END AS o_custkey FROM ({PRICES})")
def typed_edit_bool(spark, sf_dir):
    """1 is a number in a column of integers."""
    return edit.edit_cell(_prices(spark, sf_dir, "o_custkey"), 2, "o_custkey", "1", convert_column=True)


@BOOK.add(
    """WITH t AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS r, o_totalprice FROM orders)
    SELECT CAST(r AS BIGINT) AS at, CASE r WHEN 2 THEN 7.25 WHEN 4 THEN NULL ELSE o_totalprice END AS o_totalprice FROM t WHERE r IN (2, 3, 4) OR r = (SELECT count(*) FROM orders)"""
)
def cell_value(spark, sf_dir):
    """Cells through pending edits: one set twice, one as it was, one cleared, and the last one, whose edit is of another row."""
    rows = _prices(spark, sf_dir, "o_totalprice")
    patches = spark.createDataFrame([(2, "o_totalprice", "7.25", 2), (2, "o_totalprice", "9", 1), (2, "o_orderkey", "5", 3), (4, "o_totalprice", " ", 1)], "row bigint, col string, value string, seq int")
    found = [edit.cell(rows, patches, r, "o_totalprice").select(F.lit(r).cast("bigint").alias("at"), "o_totalprice") for r in (2, 3, 4, rows.count())]
    return reduce(lambda a, b: a.unionByName(b), found)


@BOOK.add("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey WHEN 3 THEN -o_orderkey END AS fitted FROM orders")
def fitted_values(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 4 == 0, key).when(F.col("o_orderkey") % 4 == 1, F.concat(key, F.lit(".75"))).when(F.col("o_orderkey") % 4 == 2, F.lit("  ")).otherwise(F.concat(F.lit("-"), key, F.lit(".5")))
    return table(spark, sf_dir, "orders").select("o_orderkey", edit.fitted(text, T.LongType()).alias("fitted"))


@BOOK.add(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey + 0.75 WHEN 3 THEN -o_orderkey - 0.5 END AS number,
    CASE WHEN o_orderkey % 3 = 0 THEN TRUE WHEN o_orderkey % 3 = 1 THEN FALSE END AS flag, CASE WHEN o_orderkey % 5 <> 2 THEN CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 3 THEN '-' ELSE 'word ' END
    || CAST(o_orderkey AS VARCHAR) || CASE o_orderkey % 5 WHEN 1 THEN '.75' WHEN 3 THEN '.5' ELSE '' END END AS words FROM orders"""
)
def fitted_kinds(spark, sf_dir):
    """Texts as cells of columns of fractions, flags and texts; blank ones and words among numbers are empty."""
    orders, key, kind = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 5
    text = F.when(kind == 0, key).when(kind == 1, F.concat(key, F.lit(".75"))).when(kind == 2, " ").when(kind == 3, F.concat(F.lit("-"), key, F.lit(".5"))).otherwise(F.concat(F.lit("word "), key))
    flag = F.when(F.col("o_orderkey") % 3 == 0, "Yes").when(F.col("o_orderkey") % 3 == 1, "false").otherwise("")
    return orders.select("o_orderkey", edit.fitted(text, T.DoubleType()).alias("number"), edit.fitted(flag, T.BooleanType()).alias("flag"), edit.fitted(text, T.StringType()).alias("words"))


@BOOK.add("SELECT CAST(c_custkey AS VARCHAR) AS key, c_acctbal AS amount FROM customer UNION ALL SELECT s_name, CAST(s_nationkey AS DOUBLE) FROM supplier")
def append_relaxed(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"))
    return edit.append_relaxed(customers, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("key"), F.col("s_nationkey").alias("amount")))


@BOOK.add("SELECT TRUE AS same_rows, FALSE AS same_edited FROM region LIMIT 1")
def fingerprint_equal(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    mixed = orders.repartition(5, "o_custkey")
    edited = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == F.lit(1), 0.0).otherwise(F.col("o_totalprice")))
    return spark.range(1).select(F.lit(stages.unchanged(orders, mixed)).alias("same_rows"), F.lit(stages.unchanged(orders, edited)).alias("same_edited"))


@BOOK.add("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1")
def replayed_steps(spark, sf_dir):
    """Steps recorded on a small part of the table, one as SQL, replayed on the whole."""
    customer = table(spark, sf_dir, "customer")
    stage = stages.Stage("customers", customer.filter("c_custkey < 50"), parameters={"least": 5000})
    stage.apply("SELECT * FROM {df} WHERE c_acctbal > :least", description="rich ones")
    stage.apply(lambda df: df.groupBy("c_mktsegment").agg(F.count("*").alias("n")), "count by segment")
    return stage.replay(customer)


@BOOK.add(
    """WITH a AS (SELECT * FROM orders WHERE o_totalprice > 1000), b AS (SELECT o_orderpriority, count(*) AS n FROM a GROUP BY 1)
    SELECT 1 AS step, (SELECT count(*) FROM orders) AS input_rows, TRUE AS same UNION ALL SELECT 2, (SELECT count(*) FROM a), TRUE UNION ALL SELECT 3, (SELECT count(*) FROM b), TRUE UNION ALL SELECT 4, least(2, (SELECT count(*) FROM b)), TRUE"""
)
def tracked_steps(spark, sf_dir):
    """Rows of each step's input, seen in passing, and whether its fingerprint is the one that a job of its own finds."""
    orders = table(spark, sf_dir, "orders")
    stage = stages.Stage("orders", orders)
    inputs = [orders, stage.apply("SELECT * FROM {df} WHERE o_totalprice > 1000"), stage.apply(lambda df: df.groupBy("o_orderpriority").agg(F.count("*").alias("n")))]
    inputs.append(stage.apply(lambda df: df.orderBy("o_orderpriority").limit(2)))
    stage.apply(lambda df: df.filter("n > 0"))
    found = stage.track()
    rows = [(k, r.input_rows, fp == stages.fingerprint(df)) for k, (r, fp, df) in enumerate(zip(stage.steps, found, inputs), 1)]
    return spark.createDataFrame(rows, "step int, input_rows bigint, same boolean")


@BOOK.add("SELECT 'rich' AS sheet, c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 2 UNION ALL SELECT 'all', c_mktsegment, count(*) FROM customer GROUP BY 2")
def branched_sheets(spark, sf_dir):
    """A branch goes its own way; the sheet that it came from stays."""
    book = stages.Workbook(spark)
    book.add("all", table(spark, sf_dir, "customer"))
    book.branch("all", "rich")
    book.apply("rich", "SELECT * FROM {df} WHERE c_acctbal > 5000", track=False)
    found = [book.apply(name, lambda df, name=name: df.groupBy("c_mktsegment").agg(F.count("*").alias("n")).select(F.lit(name).alias("sheet"), "c_mktsegment", "n"), track=False) for name in ("rich", "all")]
    return found[0].unionByName(found[1])


@BOOK.add("SELECT c_mktsegment, count(*) AS n, 1 AS sheets, 0 AS branches FROM customer GROUP BY 1")
def removed_sheet(spark, sf_dir):
    """A branch that is removed leaves its parent as it was, with no branch."""
    book = stages.Workbook(spark)
    book.add("kept", table(spark, sf_dir, "customer"))
    book.branch("kept", "dropped")
    book.apply("dropped", "SELECT * FROM {df} WHERE c_acctbal > 5000", track=False)
    book.remove("dropped")
    counted = book.apply("kept", lambda df: df.groupBy("c_mktsegment").agg(F.count("*").alias("n")), "count by segment", track=False)
    return counted.withColumns({"sheets": F.lit(len(book.stages)), "branches": F.lit(len(book.get("kept").branches))})


@BOOK.add("SELECT o_orderpriority, sum(o_totalprice) > 0 AS positive, 'positive' AS added, 'o_totalprice' AS removed FROM orders GROUP BY 1")
def changed_columns(spark, sf_dir):
    """What a step adds to the columns and takes from them, beside its rows."""
    before = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    after = before.groupBy("o_orderpriority").agg((F.sum("o_totalprice") > 0).alias("positive"))
    change = stages.schema_change(before, after)
    return after.withColumns({kind: F.lit(",".join(change[kind])) for kind in ("added", "removed")})
