"""Find rows by a condition on one column.

Conditions are typed when the plan is built, so that comparisons of numeric columns reach the file scan: an equality holds where the
cell's text form is the searched text, which the search text alone decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.types import friendly, parse_float
from gridloom.scratch import settle

ONE_VALUE = {"equals", "not_equals", "gt", "ge", "lt", "le"}
KINDS = {"is_null", "is_not_null", "between", "outside"} | ONE_VALUE


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _equals(c: Column, kind: T.DataType, text: str) -> Column:
    what = friendly(kind)
    if what == "integer":
        try:
            return c == int(text) if str(int(text)) == text else F.lit(False)
        except ValueError:
            return F.lit(False)
    if what == "float":
        value = _number(text)
        if value is None or repr(value) != text:
            return F.lit(False)
        return F.isnan(c) if math.isnan(value) else c == value
    if what == "boolean":
        return c == (text == "True") if text in ("True", "False") else F.lit(False)
    return c == text if isinstance(kind, T.StringType) else c.cast("string") == text


def _compare(c: Column, op: str, text: str | Column) -> Column:
    return {"gt": c > text, "ge": c >= text, "lt": c < text, "le": c <= text}[op]


def _ordered(c: Column, kind: T.DataType, op: str, text: str) -> Column:
    """Numbers if both sides are numbers, else the order of the texts."""
    value, what = _number(text), friendly(kind)
    if what in ("integer", "float"):
        if value is None:
            return _compare(c.cast("string"), op, text)
        if math.isnan(value):
            return F.lit(False)
        by_number = _compare(c, op, int(value) if what == "integer" and value == int(value) else value) if math.isfinite(value) else _compare(c.cast("double"), op, value)
        return by_number & ~F.isnan(c) if what == "float" and op in ("gt", "ge") else by_number
    s = c if isinstance(kind, T.StringType) else F.initcap(c.cast("string")) if what == "boolean" else c.cast("string")
    if value is None:
        return _compare(s, op, text)
    cell = parse_float(s)
    number = F.lit(False) if math.isnan(value) else _compare(cell, op, value) & ~F.isnan(cell)
    return F.when(cell.isNotNull(), number).otherwise(_compare(s, op, text))


def matches(df: DataFrame, column: str, kind: str, value: str | None = None, second: str | None = None) -> Column:
    """The condition as a column; nulls match ``is_null`` alone. ``value`` and ``second`` are texts as typed."""
    if kind not in KINDS:
        raise ValueError(f"Unknown search: {kind}")
    if kind in ONE_VALUE | {"between", "outside"} and value in (None, ""):
        raise ValueError("A value is needed")
    if kind in ("between", "outside") and second in (None, ""):
        raise ValueError("A second value is needed")
    c, dtype = F.col(column), df.schema[column].dataType
    if kind == "is_null":
        return c.isNull()
    if kind == "is_not_null":
        return c.isNotNull()
    if kind == "equals":
        return c.isNotNull() & _equals(c, dtype, str(value))
    if kind == "not_equals":
        return c.isNotNull() & ~_equals(c, dtype, str(value))
    if kind in ONE_VALUE:
        return c.isNotNull() & _ordered(c, dtype, kind, str(value))
    a, b = str(value), str(second)
    if (_number(a) is None) != (_number(b) is None) and friendly(dtype) == "text":
        s = c.cast("string")
        return c.isNotNull() & (((s >= a) & (s <= b)) if kind == "between" else ((s < a) | (s > b)))
    if kind == "between":
        return c.isNotNull() & _ordered(c, dtype, "ge", a) & _ordered(c, dtype, "le", b)
    return c.isNotNull() & (_ordered(c, dtype, "lt", a) | _ordered(c, dtype, "gt", b))


def find(df: DataFrame, column: str, kind: str, value: str | None = None, second: str | None = None) -> DataFrame:
    return df.filter(matches(df, column, kind, value, second))


def letters(index: int) -> str:
    """Spreadsheet letters of a 0-based column: A, B, ..., Z, AA."""
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def find_cells(indexed: DataFrame, column: str, kind: str, value: str | None = None, second: str | None = None) -> DataFrame:
    """(row, col, address, value): 1-based rows of the matches in a frame with ``_row`` (from 1); the address counts the header as row 1."""
    names = [c for c in indexed.columns if c != "_row"]
    at = names.index(column)
    hits = find(indexed, column, kind, value, second)
    return hits.select(F.col("_row").alias("row"), F.lit(at).alias("col"), F.concat(F.lit(letters(at)), (F.col("_row") + 1).cast("string")).alias("address"), F.col(column).cast("string").alias("value"))


def with_neighbours(hits: DataFrame) -> DataFrame:
    """Each match with the row of the next and the previous one, around the ends. Ranges of matches are ordered in their own tasks; one row a
    range links them."""
    placed = settle(hits.repartitionByRange("row", "col").withColumn("_range", F.spark_partition_id()), "search-hits")
    edges = placed.groupBy("_range").agg(F.min("row").alias("_first"), F.max("row").alias("_last"))
    order, every = Window.orderBy("_range"), Window.partitionBy()  # as many rows as ranges
    edges = edges.select(
        "_range",
        F.coalesce(F.lead("_first").over(order), F.min("_first").over(every)).alias("_after"),
        F.coalesce(F.lag("_last").over(order), F.max("_last").over(every)).alias("_before"),
    )
    inside = Window.partitionBy("_range").orderBy("row", "col")
    linked = placed.withColumns({"next_row": F.lead("row").over(inside), "previous_row": F.lag("row").over(inside)}).join(F.broadcast(edges), "_range")
    return linked.select(*hits.columns, F.coalesce("next_row", "_after").alias("next_row"), F.coalesce("previous_row", "_before").alias("previous_row"))


def nearest(hits: DataFrame, row: int, col: int) -> DataFrame:
    """The one match nearest by rows plus columns; of equal ones the first."""
    distance = F.abs(F.col("row") - row) + F.abs(F.col("col") - col)
    best = F.min_by(F.struct("row", "col", "address", "value"), F.struct(distance, F.col("row"), F.col("col")))
    return hits.agg(best.alias("best")).filter("best is not null").select("best.*")
