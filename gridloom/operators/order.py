"""Row order: a dense row index, sorts on several keys, pages.

``_row`` counts from 1. It is made by a range sort and a count of each partition; only those counts meet in one place. An order that is
looked at more than once is stored with an index of its ranges (``store``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.scratch import settle

ROW, PAGE = "_row", 1000
Keys = list[tuple[str, bool]]


def sort_columns(keys: Keys) -> list:
    """Nulls come first in both directions."""
    return [F.asc_nulls_first(name) if up else F.desc_nulls_first(name) for name, up in keys]


def sort(df: DataFrame, keys: Keys) -> DataFrame:
    return df.orderBy(*sort_columns(keys)) if keys else df


def toggled(keys: Keys, name: str) -> Keys:
    """The keys after a click on ``name``: its direction turns, or it becomes the last key, ascending."""
    if name in dict(keys):
        return [(n, not up if n == name else up) for n, up in keys]
    return [*keys, (name, True)]


def valid(keys: Keys, columns: list[str]) -> Keys:
    return [(n, up) for n, up in keys if n in columns]


def with_row_index(df: DataFrame, keys: Keys) -> DataFrame:
    """``df`` with ``_row`` in the order of ``keys``, which must be unique together."""
    names = [c for c in df.columns if c != ROW]
    parts = df.select(*names).repartitionByRange(*sort_columns(keys)).sortWithinPartitions(*sort_columns(keys))
    numbered = settle(parts.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id() % F.lit(1 << 33)}), "row-index")
    counts = numbered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row for each partition
    return numbered.join(F.broadcast(before), "__part").select((F.col("__before") + F.col("__at") + 1).alias(ROW), *names)


def reset(indexed: DataFrame) -> DataFrame:
    return indexed.orderBy(ROW)


def resolve_row(row: int, total: int) -> int:
    """The 1-based row that a typed number means: 0 is the first, negative ones count from the end."""
    got = 1 if row == 0 else total + 1 + row if row < 0 else row
    if not 1 <= got <= total:
        raise ValueError(f"Row {row} is out of range (1 to {total})")
    return got


def page_start(target: int, total: int, size: int = PAGE) -> int:
    """0-based first row of the page around the 1-based ``target``."""
    return max(0, min(target - 1 - size // 2, total - size))


def page(indexed: DataFrame, target: int, total: int, size: int = PAGE) -> DataFrame:
    start = page_start(target, total, size)
    return indexed.filter(F.col(ROW).between(start + 1, start + size)).orderBy(ROW)


def head(df: DataFrame, keys: Keys, n: int) -> DataFrame:
    return sort(df, keys).limit(n)


def tail(df: DataFrame, keys: Keys, n: int) -> DataFrame:
    """The last n rows, last one first."""
    return df.orderBy(*[F.desc_nulls_last(name) if up else F.asc_nulls_last(name) for name, up in keys]).limit(n)


class StoredOrder:
    """Rows in the order of ``keys`` as Parquet ranges with a small index, so that pages and look-ups open only the ranges they need.

    Each range is one file in the order of its rows, without row numbers: ``index`` has (part, before, rows, first, last), a row for each
    range: the rows before it and its first and last key. ``store`` makes one; ``open_order`` finds a stored one again."""

    def __init__(self, spark: SparkSession, path: str, keys: Keys, kind: T.StructType):
        self.spark, self.path, self.keys, self.kind = spark, path.rstrip("/"), keys, kind
        self.index = spark.read.parquet(f"{self.path}/index")

    @property
    def total(self) -> int:
        return self.index.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def _read(self, wanted: Column) -> DataFrame:
        """``_row`` and the columns of the ranges for which ``wanted`` (of the index) holds; other ranges' folders aren't opened."""
        parts = self.index.filter(wanted).select("part", "before").collect()  # a row for each wanted range
        names = [f.name for f in self.kind.fields]
        if not parts:
            return self.spark.createDataFrame([], T.StructType([T.StructField(ROW, T.LongType()), *self.kind.fields]))
        held = T.StructType([*self.kind.fields, T.StructField("__at", T.LongType())])
        rows = self.spark.read.schema(T.StructType([*held.fields, T.StructField("__part", T.IntegerType())])).option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/__part={r['part']}" for r in parts])
        return rows.join(F.broadcast(self.index.select(F.col("part").alias("__part"), "before")), "__part").select((F.col("before") + F.col("__at") + 1).alias(ROW), *names)

    def rows(self) -> DataFrame:
        return self._read(F.lit(True))

    def between(self, first: int, last: int) -> DataFrame:
        """The rows with the 1-based numbers ``first`` to ``last``."""
        held = (F.col("before") < last) & (F.col("before") + F.col("rows") >= first)
        return self._read(held).filter(F.col(ROW).between(first, last))

    def page(self, target: int, size: int = PAGE) -> DataFrame:
        """The page around a row, in order."""
        start = page_start(target, self.total, size)
        return self.between(start + 1, start + size).orderBy(ROW)

    def around(self, low: object, high: object) -> DataFrame:
        """The rows whose first key lies in [low, high], nulls never: only ranges that can hold some are opened."""
        name, up = self.keys[0]
        begin, end = (F.col(f"{e}.`{name}`") for e in (("first", "last") if up else ("last", "first")))
        # a range that begins with nulls has no least key, one that ends with them no greatest
        held = (begin.isNull() | (begin <= F.lit(high))) & (end.isNull() | (end >= F.lit(low)))
        return self._read(held).filter(F.col(f"`{name}`").between(low, high))


def store(df: DataFrame, keys: Keys, path: str, rows_per_range: int = 1 << 20) -> StoredOrder:
    """Write ``df`` in the order of ``keys``, unique together, to ``path`` (which must not exist) in ranges of about ``rows_per_range`` rows.

    The index is written last: a folder without it is a broken attempt that ``open_order`` refuses."""
    spark = df.sparkSession
    parts = max(1, -(-df.count() // rows_per_range))
    laid = df.repartitionByRange(parts, *sort_columns(keys)).sortWithinPartitions(*sort_columns(keys))
    numbered = laid.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id() % F.lit(1 << 33)})
    numbered.write.partitionBy("__part").option("compression", "zstd").parquet(f"{path}/rows")
    written = spark.read.schema(numbered.schema).parquet(f"{path}/rows")
    key = F.struct(*[F.col(f"`{n}`") for n, _ in keys])
    edges = written.groupBy("__part").agg(F.count("*").alias("rows"), F.min_by(key, "__at").alias("first"), F.max_by(key, "__at").alias("last"))
    before = F.sum("rows").over(Window.orderBy("__part")) - F.col("rows")  # a row for each range
    edges.select(F.col("__part").alias("part"), before.alias("before"), "rows", "first", "last").coalesce(1).write.parquet(f"{path}/index")
    return StoredOrder(spark, path, keys, df.schema)


def open_order(spark: SparkSession, path: str, keys: Keys) -> StoredOrder:
    kind = spark.read.parquet(f"{path}/rows").drop("__part", "__at").schema
    return StoredOrder(spark, path, keys, kind)
