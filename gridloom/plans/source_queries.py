"""Sources and sinks (S01-S12, K01-K10, Q22, Q23): tables written to the shared folder in each format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.plans.book import Book, table
from gridloom.scratch import new_path, shared_folder
from gridloom.sources import arrow_ipc, files, json_parts, tables
from gridloom.sources.versions import VersionedTable

BOOK = Book()
PART = "SELECT p_partkey, p_name, p_retailprice FROM part"


def _back(spark, sf_dir, extension):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    path = files.save(part, f"{shared_folder(spark)}/part-{uuid.uuid4().hex}.{extension}")
    return files.load(spark, path).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", "p_retailprice")


@BOOK.add(PART)
def csv_round_trip(spark, sf_dir):
    return _back(spark, sf_dir, "csv")


@BOOK.add(PART)
def tsv_round_trip(spark, sf_dir):
    return _back(spark, sf_dir, "tsv")


@BOOK.add(PART)
def parquet_round_trip(spark, sf_dir):
    return _back(spark, sf_dir, "parquet")


@BOOK.add(PART)
def json_round_trip(spark, sf_dir):
    return _back(spark, sf_dir, "json")


@BOOK.add(PART)
def jsonl_round_trip(spark, sf_dir):
    return _back(spark, sf_dir, "jsonl")


@BOOK.add(PART)
def arrow_ipc_round_trip(spark, sf_dir):
    return _back(spark, sf_dir, "arrow")


@BOOK.add("SELECT o_orderkey, o_totalprice, n FROM (SELECT o_orderkey, o_totalprice, 1 AS n FROM orders UNION ALL SELECT o_orderkey, o_totalprice, 2 FROM orders WHERE o_custkey % 10 = 0)")
def arrow_columns(spark, sf_dir):
    """Some columns of Arrow files, of which tasks read stretches of batches; an append shows at once."""
    orders = table(spark, sf_dir, "orders").withColumn("n", F.lit(1))
    path = files.save(orders, new_path(spark, "orders") + ".arrow")
    files.save(orders.filter("o_custkey % 10 = 0").withColumn("n", F.lit(2)), path, mode="append")
    schema = orders.select("o_orderkey", "o_totalprice", "n").schema
    return spark.read.format(arrow_ipc.NAME).option("splitBytes", 1 << 20).schema(schema).load(path)


@BOOK.add(r"""SELECT p_partkey, p_name || '"\]},{' AS note, p_size, p_brand AS first FROM part""")
def json_arrays(spark, sf_dir):
    """Arrays of 500 objects on one line, strings full of brackets and quotes, read by ranges that cut them anywhere."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit('"\\]},{')).alias("note"), F.struct("p_size", F.array("p_brand", "p_type").alias("kinds")).alias("facts"))
    arrays = part.groupBy(F.floor(F.col("p_partkey") / 500)).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*part.columns))), ", "), F.lit("]")).alias("value"))
    path = new_path(spark, "part-arrays") + ".json"
    arrays.select("value").write.text(path)
    schema = "p_partkey bigint, note string, facts struct<p_size: int, kinds: array<string>>"
    return json_parts.read(spark, path, schema, 1 << 16).select("p_partkey", "note", "facts.p_size", F.col("facts.kinds")[0].alias("first"))


@BOOK.add("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size > 25")
def save_over_source(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    path = files.save(part, f"{shared_folder(spark)}/part-{uuid.uuid4().hex}.parquet")
    files.save_over_source(files.load(spark, path).filter("p_size > 25").drop("p_size"), path)
    return files.load(spark, path)


@BOOK.add(
    """SELECT o_orderstatus, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_totalprice END), 2) AS total
    FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 5 = 0) WHERE NOT (o_custkey % 7 = 1) GROUP BY 1"""
)
def table_modes(spark, sf_dir):
    """Replace, append, update and delete on a catalog table."""
    orders, name = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), f"orders_{uuid.uuid4().hex}"
    tables.write_table(orders, name)
    tables.write_table(orders.filter("o_orderkey % 5 = 0"), name, "append")
    tables.update(spark, name, "o_totalprice", F.lit(0.0), F.col("o_orderstatus") == "O")
    tables.delete(spark, name, F.col("o_custkey") % 7 == 1)
    return tables.fetch_query(spark, f"SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {name} GROUP BY 1")


def _versioned(spark, sf_dir):
    """Orders as a versioned table of files that each hold a range of keys."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return VersionedTable.create(orders.repartitionByRange(8, "o_orderkey"), new_path(spark, "orders-versions"))


@BOOK.add(
    """SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey < 200 THEN 0.0 ELSE o_totalprice END AS o_totalprice, 3 AS versions
    FROM orders WHERE NOT (o_orderkey BETWEEN (SELECT max(o_orderkey) FROM orders) // 2 AND (SELECT max(o_orderkey) FROM orders) // 2 + 500)"""
)
def delete_key_range(spark, sf_dir):
    """A stretch of keys is deleted and another one updated; only the files that hold them are written anew."""
    held = _versioned(spark, sf_dir)
    middle = held.read().agg(F.max("o_orderkey")).first()[0] // 2
    held.delete(F.col("o_orderkey").between(middle, middle + 500))
    held.update("o_totalprice", F.lit(0.0), F.col("o_orderkey") < 200)
    return held.read().withColumn("versions", F.lit(len(held.versions())))


@BOOK.add(
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 1000 = 7 THEN NULL WHEN o_custkey % 50 = 1 THEN 'fixed' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_custkey % 50 = 1 THEN o_custkey + 0.5 ELSE o_totalprice END AS o_totalprice FROM orders"""
)
def patched_files(spark, sf_dir):
    """Single cells set by key, later ones over earlier ones, empty ones too."""
    held, orders = _versioned(spark, sf_dir), table(spark, sf_dir, "orders")
    chosen = orders.filter("o_custkey % 50 = 1")
    patches = chosen.selectExpr("o_orderkey", "'o_totalprice' as column", "'12' as value", "1 as seq").unionByName(chosen.selectExpr("o_orderkey", "'o_totalprice' as column", "concat(o_custkey, '.5') as value", "2 as seq"))
    patches = patches.unionByName(chosen.selectExpr("o_orderkey", "'o_orderstatus' as column", "'fixed' as value", "3 as seq")).unionByName(orders.filter("o_orderkey % 1000 = 7").selectExpr("o_orderkey", "'o_orderstatus' as column", "string(null) as value", "9 as seq"))
    held.patch(patches, "o_orderkey")
    return held.read()


@BOOK.add("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def all_as_text(spark, sf_dir):
    return files.as_text(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"))


@BOOK.add(
    """SELECT 'part' AS table_name, p_size AS size, count(*) AS n, (SELECT least(count(*), 1000) FROM part) AS shown FROM part GROUP BY 2
    UNION ALL SELECT 'orders', o_custkey % 7, count(*), (SELECT least(count(*), 1000) FROM orders) FROM orders GROUP BY 2"""
)
def catalog_tables(spark, sf_dir):
    """Tables of the catalog that carry this run's mark, found in the list of tables, each fetched as a whole and previewed."""
    mark, sources = uuid.uuid4().hex, {"part": F.col("p_size"), "orders": F.col("o_custkey") % 7}
    for name, size in sources.items():
        tables.write_table(table(spark, sf_dir, name).select(size.cast("bigint").alias("size")), f"{name}_{mark}")
    found = None
    for name in tables.list_tables(spark):
        if name.endswith(mark):
            rows = tables.fetch_table(spark, name).groupBy("size").agg(F.count("*").alias("n")).select(F.lit(name.removesuffix(f"_{mark}")).alias("table_name"), "size", "n", F.lit(tables.preview(spark, name).count()).cast("bigint").alias("shown"))
            found = rows if found is None else found.unionByName(rows)
    return found


@BOOK.add("SELECT 'lineitem' AS table_name, count(*) AS rows, 'preview not available' AS status FROM lineitem")
def table_status(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return tables.status(spark, "lineitem")


@BOOK.add(PART)
def explicit_format(spark, sf_dir):
    """A format that the path doesn't tell, both ways."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    path = files.save(part, f"{shared_folder(spark)}/part-{uuid.uuid4().hex}.dat", format="parquet")
    return files.load(spark, path, format="parquet")


@BOOK.add("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1")
def file_as_table(spark, sf_dir):
    path = files.save(table(spark, sf_dir, "supplier"), f"{shared_folder(spark)}/supplier-{uuid.uuid4().hex}.csv")
    files.load_as_table(spark, path, "suppliers_of_file")
    return tables.fetch_query(spark, "SELECT s_nationkey, count(*) AS n FROM suppliers_of_file GROUP BY 1")


@BOOK.add("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def parquet_as_table(spark, sf_dir):
    files.load_as_table(spark, f"{sf_dir}/customer.parquet", "customers_of_file")
    return tables.fetch_query(spark, "SELECT c_mktsegment, count(*) AS n FROM customers_of_file GROUP BY 1")


@BOOK.add("SELECT p_size, count(*) AS n, 'File does not exist' AS missing FROM part GROUP BY 1")
def checked_source(spark, sf_dir):
    """A source that passes the checks before it is loaded, beside one that doesn't exist."""
    path = files.save(table(spark, sf_dir, "part"), f"{shared_folder(spark)}/part-{uuid.uuid4().hex}.parquet")
    if why := files.check(spark, path):
        raise ValueError(why)
    missing = files.check(spark, f"{shared_folder(spark)}/none-{uuid.uuid4().hex}.parquet")
    return files.load(spark, path).groupBy("p_size").agg(F.count("*").alias("n")).withColumn("missing", F.lit(missing))


@BOOK.add(
    """SELECT column_name AS "column", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp' END AS type, TRUE AS nullable FROM (DESCRIBE events)
    UNION ALL SELECT 'n', 'int', FALSE"""
)
def described_columns(spark, sf_dir):
    """Names, types and nullability of a table's columns; one that is never null is among them."""
    table(spark, sf_dir, "events").withColumn("n", F.lit(1)).createOrReplaceTempView("described_events")
    return spark.createDataFrame([(c, f["type"].removesuffix("_ntz"), f["nullable"]) for c, f in tables.describe(spark, "described_events").items()], "column string, type string, nullable boolean")
