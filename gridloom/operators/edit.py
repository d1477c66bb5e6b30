"""Row and column edits (E01-E16). Frames with rows carry ``_row`` from 1; positions are short lists, as literals of the plan, or tables, as
cell patches are."""

from __future__ import annotations

import keyword
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.types import STORAGE, TRUE_WORDS, conflicts, convert, friendly, infer_value, parse_float, strip
from gridloom.operators.order import ROW
from gridloom.scratch import settle

#: What a column name may not hold or be.
FORBIDDEN = " \t\n\r\f\v()[]{}.,;:!@#$%^&*+=|\\/<>?`~\"'"
RESERVED = (
    "select from where insert update delete create drop table index view function procedure trigger database schema primary foreign key "
    "constraint null not and or in like between exists case when then else group order by having limit offset union join inner outer "
    "left right on as distinct all"
).split()
LONGEST_NAME = 100


def name_error(name: str, columns: list[str], old: str | None = None) -> str | None:
    """Why ``name`` can't be a column's name, or None. Spark takes names of other case as the same."""
    others = {c.lower() for c in columns if c != old}
    rules = (
        (not name.strip(), "is blank"),
        (name.lower() in others, "is taken"),
        (name.isdigit(), "is a number"),
        (name[:1].isdigit(), "starts with a digit"),
        (keyword.iskeyword(name), "is a Python keyword"),
        (any(c in FORBIDDEN for c in name), "holds a character that is not allowed"),
        (len(name) > LONGEST_NAME, f"is longer than {LONGEST_NAME} characters"),
        (name.lower() in RESERVED, "is a reserved SQL word"),
    )
    return next((f"Column name '{name}' {why}" for bad, why in rules if bad), None)


def free_name(columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    return next(f"Column_{n}" for n in range(1, len(columns) + 2) if f"column_{n}" not in taken)


def add_column(df: DataFrame, at: int | None = None) -> DataFrame:
    """A null text column at a 0-based place; past the end, or without one, it is the last."""
    names = df.columns
    at = len(names) if at is None else min(max(at, 0), len(names))
    new = F.lit(None).cast("string").alias(free_name(names))
    return df.select(*[F.col(f"`{c}`") for c in names[:at]], new, *[F.col(f"`{c}`") for c in names[at:]])


def delete_column(df: DataFrame, at: int) -> DataFrame:
    """Without its last column a table keeps its rows, with one null text column."""
    names = [c for c in df.columns if c != ROW]
    if not 0 <= at < len(names):
        raise ValueError(f"No column {at}")
    return df.withColumn("Column_1" if names[0] != "Column_1" else names[0], F.lit(None).cast("string")).select(*[c for c in (ROW,) if c in df.columns], "Column_1") if len(names) == 1 else df.drop(names[at])


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if why := name_error(new, df.columns, old):
        raise ValueError(why)
    return df.withColumnRenamed(old, new)


def _null_rows(df: DataFrame, rows: list[int]) -> DataFrame:
    new = df.sparkSession.createDataFrame([(r,) for r in rows], f"{ROW} bigint")
    return new.select(*[F.col(ROW) if c == ROW else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])


def append_row(df: DataFrame) -> DataFrame:
    """A null row behind the last one."""
    last = df.agg(F.coalesce(F.max(ROW), F.lit(0)).alias("last"))
    return df.unionByName(last.select(*[(F.col("last") + 1).alias(ROW) if c == ROW else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]))


def _count_before(places: list[int], inclusive: bool) -> Column:
    held = F.array(*[F.lit(p).cast("bigint") for p in sorted(places)])
    return F.size(F.filter(held, lambda p: p <= F.col(ROW) if inclusive else p < F.col(ROW)))


#: Row numbers of a block in which edit positions are summed up.
BLOCK = 1 << 16


def _running(rows: DataFrame, at: str, value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows up to the own number ``at``: within blocks of numbers, and over the blocks' totals."""
    cut = rows.withColumn("__block", F.floor(F.col(at) / BLOCK))
    inside = Window.partitionBy("__block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    totals = cut.groupBy("__block").agg(F.sum(value).alias("__sum")).select("__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    return cut.withColumn("__inside", F.sum(value).over(inside)).join(totals, "__block").withColumn(out, F.col("__inside") + F.col("__before")).drop("__block", "__inside", "__before")


def _places(positions: DataFrame, low: int, high: int, clip: bool) -> DataFrame:
    """(__p, __k): the positions of a table's first column and how often each occurs, in the shared folder."""
    held = positions.select(F.col(f"`{positions.columns[0]}`").cast("bigint").alias("__p"))
    held = settle((held.withColumn("__p", F.when(F.col("__p") > high, high).otherwise(F.col("__p"))) if clip else held).groupBy("__p").agg(F.count("*").alias("__k")), "edit-places")
    if not held.filter(f"__p is null or __p < {low} or __p > {high}").isEmpty():
        raise ValueError(f"Row out of range ({low} to {high})")
    return held


def insert_rows(df: DataFrame, positions: list[int] | DataFrame) -> DataFrame:
    """Null rows before the given 1-based rows (of the table as it is); places past the end append. ``_row`` stays dense.

    Few positions are a list; any number of them is a table, whose first column holds them, and is joined by row."""
    if isinstance(positions, DataFrame):
        places = _places(positions, 1, df.count() + 1, True)
        marked = df.join(places, df[ROW] == F.col("__p"), "left").drop("__p").withColumn("__k", F.coalesce("__k", F.lit(0)))
        moved = _running(marked, ROW, "__k", "__shift").withColumn(ROW, F.col(ROW) + F.col("__shift")).drop("__k", "__shift")
        new = _running(places, "__p", "__k", "__upto").select((F.col("__p") + F.col("__upto") - F.col("__k")).alias("__first"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__k") - 1)).alias("__n"))
        return moved.unionByName(new.select(*[(F.col("__first") + F.col("__n")).alias(ROW) if c == ROW else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]))
    if any(p < 1 for p in positions):
        raise ValueError("Rows are inserted at 1 or later")
    total = df.count()
    places = sorted(min(p, total + 1) for p in positions)
    moved = df.withColumn(ROW, (F.col(ROW) + _count_before(places, True)).cast("bigint"))
    return moved.unionByName(_null_rows(df, [p + k for k, p in enumerate(places)]))


def delete_rows(df: DataFrame, positions: list[int] | DataFrame) -> DataFrame:
    """Without the given 1-based rows; ``_row`` stays dense. Positions as for ``insert_rows``."""
    if isinstance(positions, DataFrame):
        places = _places(positions, 1, df.count(), False)
        marked = df.join(places, df[ROW] == F.col("__p"), "left").drop("__k").withColumn("__gone", F.col("__p").isNotNull().cast("bigint")).drop("__p")
        return _running(marked, ROW, "__gone", "__shift").filter("__gone = 0").withColumn(ROW, F.col(ROW) - F.col("__shift")).drop("__gone", "__shift")
    places = sorted(set(positions))
    total = df.count()
    if any(not 1 <= p <= total for p in places):
        raise ValueError(f"Row out of range (1 to {total})")
    kept = df.filter(~F.col(ROW).isin(places))
    return kept.withColumn(ROW, (F.col(ROW) - _count_before(places, False)).cast("bigint"))


def truthy(text: Column) -> Column:
    return F.lower(strip(text)).isin(*TRUE_WORDS)


def fitted(value: Column, kind: T.DataType) -> Column:
    """A typed text as a value of a column's type (E14): blank is null, floats are cut off for integers."""
    what = friendly(kind)
    blank = value.isNull() | (strip(value) == "")
    if what == "integer":
        number = parse_float(value)
        new = F.coalesce(F.when(strip(value).rlike(r"^[+-]?\d+$"), strip(value).try_cast("bigint")), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).try_cast("bigint"))
    elif what == "float":
        new = parse_float(value)
    elif what == "boolean":
        new = truthy(value)
    else:
        new = value
    return F.when(~blank, new.try_cast(kind))


def apply_patches(df: DataFrame, patches: DataFrame) -> DataFrame:
    """Set cells: ``patches`` (row, col, value, seq), texts; of several for a cell the last by seq counts, a null or blank one clears the
    cell. One aggregation brings them to a row for each ``_row``, then one join."""
    names = [c for c in df.columns if c != ROW]
    last = [F.max_by(F.when(F.col("col") == c, F.struct("value")), F.when(F.col("col") == c, F.col("seq"))).alias(f"__new_{k}") for k, c in enumerate(names)]
    wide = patches.groupBy(F.col("row").alias("__row")).agg(*last)
    both = df.join(wide, df[ROW] == wide["__row"], "left")
    cells = [F.when(F.col(f"__new_{k}").isNotNull(), fitted(F.col(f"__new_{k}.value"), df.schema[c].dataType)).otherwise(df[c]).alias(c) for k, c in enumerate(names)]
    return both.select(df[ROW], *cells)


def cell(df: DataFrame, patches: DataFrame, row: int, column: str) -> DataFrame:
    """One cell as it is after the pending patches."""
    here = patches.filter((F.col("row") == row) & (F.col("col") == column))
    return apply_patches(df.filter(F.col(ROW) == row).select(ROW, column), here).select(column)


def edit_cell(df: DataFrame, row: int, column: str, value: str, convert_column: bool = False) -> DataFrame:
    """A typed edit (E12): an empty column takes the value's type; a value that doesn't fit the column converts it, or is fitted to it.

    A whole number fits a float column, and 0 and 1 fit a column of numbers, so neither converts any."""
    spark = df.sparkSession
    kind = friendly(df.schema[column].dataType)
    patch = spark.createDataFrame([(row, column, value, 1)], "row bigint, col string, value string, seq int")
    given = infer_value(F.col("value"))
    facts = patch.select(given.alias("kind"), conflicts(kind, given).alias("conflict")).first()
    if facts.kind and df.filter(F.col(f"`{column}`").isNotNull()).limit(1).count() == 0:
        df = df.withColumn(column, F.lit(None).cast(STORAGE[facts.kind]))
    elif facts.conflict and convert_column:
        df = convert(df, column, facts.kind)
    return apply_patches(df, patch)


_WIDTH = {"boolean": 0, "integer": 1, "float": 2, "text": 3}


def append_relaxed(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``other`` behind those of ``df``; columns of the same name take the wider of two types (integer, float, text)."""
    if [c.lower() for c in df.columns] != [c.lower() for c in other.columns]:
        raise ValueError("Column names differ")
    wider = []
    for a, b in zip(df.schema.fields, other.schema.fields):
        if a.dataType == b.dataType:
            wider.append(a.dataType.simpleString())
            continue
        x, y = friendly(a.dataType), friendly(b.dataType)
        wider.append("string" if {x, y} & {"text", "boolean"} and x != y else STORAGE[max(x, y, key=_WIDTH.get)])
    cast = lambda frame: frame.select(*[F.col(f"`{c}`").cast(k).alias(n) for c, k, n in zip(frame.columns, wider, df.columns)])
    return cast(df).union(cast(other))


def safe_header(name: str, k: int) -> str:
    return re.sub(r"\s+", " ", name).strip() or f"Column_{k + 1}"
