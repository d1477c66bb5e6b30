"""SQL functions whose meaning differs from Spark's of the same name (Q10, Q12, Q13), and small helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strftime codes and Spark's patterns.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%p": "a", "%I": "hh", "%f": "SSSSSS", "%%": "%"}


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """Number of boundaries of ``unit`` between two times."""
    years = F.year(end) - F.year(start)
    if unit == "year":
        return years.cast("bigint")
    if unit == "quarter":
        return (years * 4 + F.quarter(end) - F.quarter(start)).cast("bigint")
    if unit == "month":
        return (years * 12 + F.month(end) - F.month(start)).cast("bigint")
    if unit == "day":
        return F.datediff(end, start).cast("bigint")
    if unit == "week":
        return F.floor(F.datediff(F.date_trunc("week", end), F.date_trunc("week", start)) / 7).cast("bigint")
    size = {"hour": 3600, "minute": 60, "second": 1}[unit]
    cut = lambda t: F.unix_timestamp(F.date_trunc(unit, t))
    return ((cut(end) - cut(start)) / size).cast("bigint")


def strftime(time: Column, pattern: str) -> Column:
    parts = []
    for code, text in re.findall(r"(%.)|([^%]+)", pattern):
        if code and code not in STRFTIME:
            raise ValueError(f"Unknown format code: {code}")
        parts.append(STRFTIME[code] if code and code != "%%" else "'" + (text or "%").replace("'", "''") + "'")
    return F.date_format(time, "".join(parts))


def age(end: Column, start: Column) -> tuple[Column, Column]:
    """Whole months between two days, and the days left, borrowed from the earlier day's month (both may be negative)."""
    low, high = F.least(end, start), F.greatest(end, start)
    short = F.dayofmonth(high) < F.dayofmonth(low)
    months = (F.year(high) - F.year(low)) * 12 + F.month(high) - F.month(low) - short.cast("int")
    days = F.dayofmonth(high) - F.dayofmonth(low) + F.when(short, F.dayofmonth(F.last_day(low))).otherwise(0)
    sign = F.when(end < start, -1).otherwise(1)
    return (months * sign).cast("bigint"), (days * sign).cast("bigint")


def concat_str(columns: list[Column], separator: str = "", ignore_nulls: bool = False) -> Column:
    """Joined texts; null as soon as one part is null, unless those are left out."""
    joined = F.concat_ws(separator, *columns)
    if ignore_nulls:
        return joined
    some = columns[0].isNull()
    for c in columns[1:]:
        some = some | c.isNull()
    return F.when(~some, joined)


def n_unique(column: Column) -> Column:
    """Aggregate: distinct values, null being one."""
    return F.count_distinct(column) + F.max(column.isNull().cast("int"))


def replace_first(text: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(text, f"(?s)^(.*?)(?:{pattern})", "$1" + new.replace("\\", "\\\\").replace("$", "\\$"))


def compact(number: Column, units: str = "KMB") -> Column:
    """``999``, ``1.2K``, ``3.4M``, ``5.6B``; 999.95 of a unit goes to the next one in ``units``."""
    n = number.cast("double")
    text = n.cast("bigint").cast("string")
    for size, unit in zip((1e3, 1e6, 1e9), units):
        least = size if unit == "K" else size * 0.99995
        text = F.when(n >= least, F.concat(F.format_string("%.1f", F.round(n / size, 1)), F.lit(unit))).otherwise(text)
    return text


def exact_sum(number: Column) -> Column:
    """The sum of doubles that doesn't depend on the order of rows: of their decimals, rounded once. Values that ten decimals don't hold are
    summed as doubles."""
    decimal = number.try_cast("decimal(28,10)")
    held = F.count(F.when(decimal.cast("double") == number, 1)) == F.count(number)
    return F.when(held, F.try_sum(decimal).cast("double")).otherwise(F.sum(number))


def dimensions(rows: int, columns: int) -> str:
    return f"{rows:,} rows, {columns} columns"
