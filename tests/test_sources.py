"""Files, Arrow IPC, catalog tables and JDBC."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.sources import files, tables


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "é,\"x\"", 1.5, True), (2, None, None, False), (3, "tab\there", -2.0, None)], "id bigint, name string, x double, ok boolean").repartition(2)


@pytest.mark.parametrize("ext", ["csv", "tsv", "parquet", "json", "jsonl", "ndjson", "arrow", "feather", "ipc", "txt"])
def test_round_trip(spark, rows, tmp_path, ext):
    path = files.save(rows, f"file://{tmp_path}/t.{ext}")
    back = files.load(spark, path).select(*rows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    files.save(rows.filter("id = 1"), path)
    assert files.load(spark, path).count() == 1
    files.save(rows.filter("id = 2"), path, mode="append")
    assert files.load(spark, path).count() == 2


def test_formats_and_errors(spark, rows, tmp_path):
    base = f"file://{tmp_path}"
    assert files.save(rows, f"{base}/noext") == f"{base}/noext.csv"
    files.save(rows, f"{base}/data", format="parquet")
    assert files.load(spark, f"{base}/data", "parquet").count() == 3
    with pytest.raises(ValueError, match="Unsupported file format"):
        files.load(spark, f"{base}/data", "xml")
    with pytest.raises(ValueError, match="Unsupported file format"):
        files.save(rows, f"{base}/data", format="xml")
    with pytest.raises(FileNotFoundError):
        files.load(spark, f"{base}/missing.csv")
    (tmp_path / "doc.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.load(spark, f"{base}/doc.json").count() == 2
    (tmp_path / "bad.csv").write_text("a,b\n1,2\nx,3\n")
    assert files.bad_lines(spark, f"{base}/bad.csv", "a int, b int") == 1
    assert files.load(spark, f"{base}/bad.csv", schema="a string, b string").dtypes == [("a", "string"), ("b", "string")]


def test_source_check(spark, tmp_path):
    base = f"file://{tmp_path}"
    (tmp_path / "ok.csv").write_text("a\n1\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "odd.xyz").write_text("a")
    (tmp_path / "broken.parquet").write_text("no parquet")
    assert files.check(spark, f"{base}/ok.csv") is None
    assert [bool(files.check(spark, f"{base}/{n}")) for n in ("empty.csv", "odd.xyz", "broken.parquet", "none.csv")] == [True] * 4


def test_save_over_source(spark, rows, tmp_path):
    for ext in ("parquet", "csv", "arrow"):
        path = files.save(rows, f"file://{tmp_path}/over.{ext}")
        df = files.load(spark, path)
        files.save_over_source(df.filter("id > 1"), path)
        assert files.load(spark, path).count() == 2


def test_empty_and_text_tables(spark, rows):
    assert files.empty_table(spark).count() == 10 and files.empty_table(spark).columns == [f"Column_{k}" for k in range(1, 6)]
    assert {k for _, k in files.as_text(rows).dtypes} == {"string"}


def test_catalog(spark, rows):
    name = "t_" + datetime.datetime.now().strftime("%H%M%S%f")
    try:
        tables.write_table(rows, name)
        tables.write_table(rows, name, "append")
        assert tables.fetch_table(spark, name).count() == 6 and name in tables.list_tables(spark)
        with pytest.raises(Exception, match="already exists"):
            tables.write_table(rows, name, "fail")
        with pytest.raises(ValueError):
            tables.write_table(rows, name, "upsert")
        tables.update(spark, name, "x", F.lit(9), F.col("id") == 2)
        tables.delete(spark, name, F.col("ok"))
        back = tables.fetch_query(spark, f"SELECT id, x FROM {name} WHERE x >= :least", least=9)
        assert [r.x for r in back.collect()] == [9.0, 9.0] and tables.fetch_table(spark, name).count() == 4
        assert tables.describe(spark, name)["id"]["type"] == "bigint"
        assert tables.preview(spark, name, 2).count() == 2 and tables.status(spark, name).first().rows == 4
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_urls():
    assert tables.jdbc_url("postgres://u:p%40ss@h/db") == ("jdbc:postgresql://h:5432/db", {"user": "u", "password": "p@ss"})
    assert tables.build_url("mysql", "h", "db", "u", "p@ss") == "mysql://u:p%40ss@h:3306/db"
    assert tables.jdbc_url(tables.build_url("mysql", "h", "db", "u")) == ("jdbc:mysql://h:3306/db", {"user": "u"})
    with pytest.raises(ValueError):
        tables.jdbc_url("oracle://h/db")


def test_jdbc(spark, rows):
    url = f"jdbc:derby:memory:t{datetime.datetime.now().strftime('%H%M%S%f')};create=true"
    tables.write_table(rows.select("id", "x"), "numbers", "fail", url)
    df = tables.read_jdbc(spark, url, "numbers", "id", parts=3)
    assert df.rdd.getNumPartitions() == 3 and df.count() == 3
    plan = df.filter("id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo" in plan.replace("ID", "id") or "id = 2" in plan
    tables.write_table(rows.select("id", "x"), "numbers", "append", url)
    assert tables.read_jdbc(spark, url, "numbers").count() == 6
