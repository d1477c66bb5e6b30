"""Catalog and JDBC tables."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.scratch import settle

#: Fixed values.
PORTS = {"mysql": 3306, "postgresql": 5432}
SCHEMES = {"mysql": "mysql", "postgresql": "postgresql", "postgres": "postgresql"}
MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}
PREVIEW = 1000


def fetch_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def fetch_query(spark: SparkSession, sql: str, **parameters) -> DataFrame:
    return spark.sql(sql, args=parameters or None)


def build_url(kind: str, host: str, database: str, user: str, password: str | None = None, port: int | None = None) -> str:
    secret = f":{quote(password, safe='')}" if password else ""
    return f"{kind}://{quote(user, safe='')}{secret}@{host}:{port or PORTS[SCHEMES[kind]]}/{database}"


def jdbc_url(url: str) -> tuple[str, dict[str, str]]:
    """A database URL as a JDBC URL and properties; only MySQL and PostgreSQL."""
    parts = urlsplit(url)
    if parts.scheme not in SCHEMES:
        raise ValueError(f"Unsupported database URL: {parts.scheme or url}")
    kind = SCHEMES[parts.scheme]
    properties = {k: unquote(v) for k, v in (("user", parts.username), ("password", parts.password)) if v}
    return f"jdbc:{kind}://{parts.hostname}:{parts.port or PORTS[kind]}/{parts.path.lstrip('/')}", properties


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, parts: int = 8, properties: dict[str, str] | None = None) -> DataFrame:
    """A remote table; with a numeric ``column`` as ``parts`` ranges of it, whose ends a pushed query finds. Filters go to the database."""
    if not url.startswith("jdbc:"):
        url, known = jdbc_url(url)
        properties = known | (properties or {})
    properties = properties or {}
    if column is None:
        return spark.read.jdbc(url, table, properties=properties)
    quoted = f"`{column}`" if url.startswith("jdbc:mysql") else f'"{column}"'
    low, high = spark.read.jdbc(url, f"(select min({quoted}) as lo, max({quoted}) as hi from {table}) t", properties=properties).first()
    if low is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=column, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts, properties=properties)


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def describe(spark: SparkSession, table: str) -> dict[str, dict[str, object]]:
    return {c.name: {"type": c.dataType, "nullable": c.nullable} for c in spark.catalog.listColumns(table)}


def preview(spark: SparkSession, table: str, n: int = PREVIEW) -> DataFrame:
    return spark.table(table).limit(n)


def status(spark: SparkSession, table: str) -> DataFrame:
    """One row with the count, for tables whose rows can't be shown."""
    return spark.table(table).agg(F.count("*").alias("rows")).select(F.lit(table).alias("table_name"), "rows", F.lit("preview not available").alias("status"))


def write_table(df: DataFrame, table: str, mode: str = "replace", url: str | None = None, properties: dict[str, str] | None = None) -> None:
    if mode not in MODES:
        raise ValueError(f"Unknown mode: {mode}")
    if url is not None:
        df.write.mode(MODES[mode]).jdbc(url, table, properties=properties or {})
        return
    if mode == "replace" and df.sparkSession.catalog.tableExists(table):
        df = settle(df, "replace")  # the new rows may come from the table itself
    df.write.mode(MODES[mode]).saveAsTable(table)


def rewrite(spark: SparkSession, table: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """A table as ``change`` makes it: plain tables have no update in place."""
    write_table(change(spark.table(table)), table, "replace")


def update(spark: SparkSession, table: str, column: str, value: Column, where: Column) -> None:
    rewrite(spark, table, lambda df: df.withColumn(column, F.when(where, value.cast(df.schema[column].dataType)).otherwise(F.col(column))))


def delete(spark: SparkSession, table: str, where: Column) -> None:
    rewrite(spark, table, lambda df: df.filter(~F.coalesce(where, F.lit(False))))
