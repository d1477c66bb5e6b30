"""Friendly types, conversion and inference as column expressions.

Texts are read as the spreadsheet reads them: blanks around them don't count, a blank text is null, and only plain decimal numbers,
``nan`` and ``inf`` are numbers (Spark's own cast also takes ``1d``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
NUMBER_IN_TEXT = r"[-+]?(?:\d+\.?\d*|\.\d+)"
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
TRUE_WORDS = ("true", "1", "yes", "y", "on")
BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0", "y", "n")
STORAGE = {"integer": "bigint", "float": "double", "boolean": "boolean", "text": "string"}
ADVICE_SHARE = 0.5


def friendly(kind: T.DataType) -> str:
    """integer, float, boolean or text; dates, decimals and nested types count as text."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    return "boolean" if isinstance(kind, T.BooleanType) else "text"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_float(text: Column) -> Column:
    """The number that a whole text is, else null."""
    s = strip(text)
    word = F.lower(F.regexp_replace(s, r"^[+-]", ""))
    negative = s.startswith("-")
    special = F.when(word == "nan", F.lit(float("nan"))).when(word.isin("inf", "infinity"), F.when(negative, float("-inf")).otherwise(float("inf")))
    return F.when(s.rlike(NUMBER), s.try_cast("double")).otherwise(special)


def number_in_text(text: Column) -> Column:
    """The first number in a text; a comma ends it, so ``$2,217`` gives 2."""
    return F.nullif(F.regexp_extract(text, NUMBER_IN_TEXT, 0), F.lit("")).try_cast("double")


def number_has_point(text: Column) -> Column:
    return F.regexp_extract(text, NUMBER_IN_TEXT, 0).contains(".")


def _whole(value: Column) -> Column:
    """A double without its fraction as bigint; null where that is none."""
    fits = ~F.isnan(value) & (F.abs(value) < F.lit(9.2e18))
    return F.when(fits, F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("bigint"))


def extract_numbers(text: Column, target: str) -> Column:
    """First numbers as ``integer`` (null where there is a fraction) or ``float``."""
    found = number_in_text(text)
    return found if target == "float" else F.when(found == F.floor(found), _whole(found))


def convert_text(text: Column, target: str) -> Column:
    """A text column as ``target``: a whole number text, else its float cut off, else the first number in it."""
    s = strip(text)
    blank = text.isNull() | (s == "")
    if target == "text":
        return text
    if target == "boolean":
        return F.when(~blank, F.lower(s).isin(*TRUE_WORDS))
    value = parse_float(text)
    if target == "float":
        return F.when(~blank, F.coalesce(value, number_in_text(text)))
    exact = F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint"))
    return F.when(~blank, F.coalesce(exact, F.when(value.isNotNull(), _whole(value)).otherwise(extract_numbers(text, "integer"))))


def convert(df: DataFrame, column: str, target: str) -> DataFrame:
    """Change a column's type (T01): text goes by ``convert_text``, typed columns by a cast, floats to integers by cutting off."""
    if target not in STORAGE:
        raise ValueError(f"Unknown target type: {target}")
    have, c = friendly(df.schema[column].dataType), F.col(column)
    if have == "text" and isinstance(df.schema[column].dataType, T.StringType):
        new = convert_text(c, target)
    elif target == "integer" and have == "float":
        new = _whole(c.cast("double"))
    elif target == "boolean":
        new = convert_text(c.cast("string"), "boolean") if have == "text" else c != 0 if have != "boolean" else c
    else:
        new = c.try_cast(STORAGE[target])
    return df.withColumn(column, new.cast(STORAGE[target]))


def infer_value(text: Column) -> Column:
    """Type name of one value: null for blanks, boolean words before integers, integers before floats."""
    s = strip(text)
    return (
        F.when(text.isNull() | (s == ""), F.lit(None).cast("string"))
        .when(F.lower(s).isin(*BOOLEAN_WORDS), "boolean")
        .when(s.rlike(r"^[+-]?\d+$"), "integer")
        .when(parse_float(text).isNotNull(), "float")
        .otherwise("text")
    )


def infer_column(text: Column) -> Column:
    """Aggregate: the type that all values of a column fit. 0 and 1 are integers as soon as another number is there."""
    kind = infer_value(text)
    digit = strip(text).isin("0", "1")
    has = lambda what: F.coalesce(F.bool_or(what), F.lit(False))
    words, numbers = has((kind == "boolean") & ~digit), has(kind.isin("integer", "float"))
    return (
        F.when(F.count(kind) == 0, F.lit(None).cast("string"))
        .when(has(kind == "text") | (words & numbers), "text")
        .when(has(kind == "float"), "float")
        .when(has(kind == "integer"), "integer")
        .otherwise("boolean")
    )


def conflicts(column_type: str, value_type: Column) -> Column:
    """Does a value of this inferred type not fit a column of ``column_type``? Null always fits, text takes anything."""
    fits = {"integer": ("integer", "boolean"), "float": ("integer", "float", "boolean"), "boolean": ("boolean",), "text": ("integer", "float", "boolean", "text")}[column_type]
    if column_type in ("integer", "float"):
        fits = tuple(f for f in fits if f != "boolean")
        return F.when(value_type.isNull(), False).otherwise(value_type.isin("text", *(("float",) if column_type == "integer" else ())))
    return F.when(value_type.isNull(), False).otherwise(~value_type.isin(*fits))


def pasted_number(text: Column) -> Column:
    """A pasted cell as a number: commas, percent and plus signs go, the Unicode minus counts; null if it is none."""
    s = F.translate(strip(text), "−,%+", "-")
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def extraction_advice(df: DataFrame) -> DataFrame:
    """One row for each text column: (column, share, kind): the share of non-blank values that hold a number, and ``float`` if any of
    those has a point, else ``integer``; kind is null under half. One aggregate over the whole table."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    parts = []
    for name in names:
        c = F.when(strip(F.col(name)) != "", F.col(name))
        share = F.avg(F.when(c.isNotNull(), number_in_text(c).isNotNull().cast("double")))
        point = F.coalesce(F.bool_or(number_has_point(c)), F.lit(False))
        parts.append(F.struct(F.lit(name).alias("column"), share.alias("share"), F.when(share >= ADVICE_SHARE, F.when(point, "float").otherwise("integer")).alias("kind")))
    if not names:
        return df.sparkSession.createDataFrame([], "column string, share double, kind string")
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all"))


def is_empty(column: str) -> Column:
    """Aggregate: has the column no value at all?"""
    return F.count(F.col(column)) == 0
