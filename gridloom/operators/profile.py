"""Profile of a table (D01-D10): one aggregation for all columns; exact medians and exact distinct counts of all columns come from one narrow
shuffle each, with no state that grows with a column's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.types import friendly
from gridloom.operators import ranks
from gridloom.operators.order import Keys, head, tail
from gridloom.scratch import settle

#: Text columns with more distinct values have no counts.
CATEGORIES = 25


def percent(part: Column, rows: Column) -> Column:
    return F.when(rows == 0, 0.0).otherwise(F.round(100 * part / rows, 2))


def medians(df: DataFrame, names: list[str]) -> dict[str, float | None]:
    """Exact medians of numeric columns, all at once; one row a column reaches the driver."""
    found = {r["column"]: r["quantile"] for r in ranks.quantiles(df, [], names, 0.5, "linear").collect()} if names else {}
    return {c: found.get(c) for c in names}


#: Characters of a value that travel with its hash.
HEAD = 64


def _hashes(df: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """(place, h1, h2, ...) for each value of the text columns ``names``: 128 bits stand for it; ``more`` may use ``value``."""
    pairs = [F.struct(F.lit(k).alias("place"), F.xxhash64(F.lit(1), f"`{c}`").alias("h1"), F.xxhash64(F.lit(2), f"`{c}`").alias("h2"), F.col(f"`{c}`").alias("value")) for k, c in enumerate(names)]
    return df.select(F.inline(F.array(*pairs))).filter("value is not null").select("place", "h1", "h2", *more)


def text_facts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, distinct, value, n, length) of the text columns: exact number of distinct values, the most common one (of equally common ones
    the least), its count and length.

    Values are counted by hashes with their first ``HEAD`` characters; whole values are read again only where the winner is longer, and meet
    in a minimum a column. A column of nulls has 0 distinct values."""
    if names is None:
        names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    kind = "column string, distinct bigint, value string, n bigint, length int"
    if not names:
        return df.sparkSession.createDataFrame([], kind)
    counts = settle(_hashes(df, names, F.substring("value", 1, HEAD).alias("head")).groupBy("place", "h1", "h2").agg(F.count("*").alias("n"), F.min("head").alias("head")), "text-counts")
    tops = settle(counts.groupBy("place").agg(F.count("*").alias("distinct"), F.min(F.struct((-F.col("n")).alias("m"), "head")).alias("best")), "text-tops")
    cut = tops.filter(F.length("best.head") == HEAD)
    texts = None
    if not cut.isEmpty():
        best = cut.select("place", F.col("best.m").alias("m"), F.col("best.head").alias("best_head"))
        winners = settle(counts.join(best, "place").filter("n = -m and head = best_head").select("place", "h1", "h2"), "text-winners")
        texts = _hashes(df, names, F.col("value")).join(winners, ["place", "h1", "h2"]).groupBy("place").agg(F.min("value").alias("text"))
    every = df.sparkSession.createDataFrame(list(enumerate(names)), "place int, column string").join(tops, "place", "left")
    every = every.join(texts, "place", "left") if texts is not None else every.withColumn("text", F.lit(None).cast("string"))
    value = F.coalesce("text", "best.head")
    return every.select("column", F.coalesce("distinct", F.lit(0).cast("long")).alias("distinct"), value.alias("value"), (-F.col("best.m")).alias("n"), F.length(value).alias("length"))


def distinct_counts(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Exact numbers of distinct values of text columns: one shuffle of hashes for all of them."""
    if not names:
        return {}
    found = _hashes(df, names).distinct().groupBy("place").count().collect()
    return {c: 0 for c in names} | {names[r["place"]]: r["count"] for r in found}


def profile_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """A row for each column: type, friendly, rows, nulls, null_percent, n, min, max, mean, median, std, distinct.

    Numeric columns have n to std (std 0 for one value), text columns distinct. ``exact=False`` takes approximate medians and counts."""
    rows, parts = F.count(F.lit(1)), []
    middle = medians(df, [f.name for f in df.schema.fields if friendly(f.dataType) in ("integer", "float")]) if exact else {}
    unlike = distinct_counts(df, [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]) if exact else {}
    none = F.lit(None).cast("double")
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), friendly(f.dataType)
        number, text = kind in ("integer", "float"), isinstance(f.dataType, T.StringType)
        d = c.cast("double")
        facts = {
            "min": F.min(d) if number else none,
            "max": F.max(d) if number else none,
            "mean": F.avg(d) if number else none,
            "median": (F.lit(middle[f.name]).cast("double") if exact else F.percentile_approx(d, 0.5)) if number else none,
            "std": F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(d)) if number else none,
            "distinct": (F.lit(unlike[f.name]).cast("bigint") if exact else F.approx_count_distinct(c)) if text else F.lit(None).cast("bigint"),
        }
        nulls = F.count_if(c.isNull())
        parts.append(
            F.struct(
                F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(kind).alias("friendly"), rows.alias("rows"), nulls.alias("nulls"), percent(nulls, rows).alias("null_percent"),
                (F.count(c) if number else F.lit(None).cast("bigint")).alias("n"), *[v.alias(k) for k, v in facts.items()],
            )
        )
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all"))


def text_counts(df: DataFrame, most: int | None = None) -> DataFrame:
    """(column, value, n) of all text columns in one aggregation; null is a value. With ``most`` only of those that may have no more distinct
    values, by an approximate count first, so that the values of all others stay where they are."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if names and most is not None:
        about = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(str(k)) for k, c in enumerate(names)]).first()
        names = [c for k, c in enumerate(names) if about[k] <= 2 * most]  # the estimate errs by a twentieth
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in names])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))


def top_value(counts: DataFrame) -> DataFrame:
    """(column, value, n, length): the most common value of each column; of equally common ones the least."""
    most = counts.filter("value is not null").groupBy("column").agg(F.max("n").alias("n"))
    least = counts.filter("value is not null").join(most, ["column", "n"]).groupBy("column", "n").agg(F.min("value").alias("value"))
    return least.select("column", "value", "n", F.length("value").alias("length"))


def small_counts(counts: DataFrame, most: int = CATEGORIES) -> DataFrame:
    """Counts of the columns with 1 to ``most`` distinct values."""
    size = counts.groupBy("column").agg(F.count("value").alias("distinct")).filter(F.col("distinct").between(1, most))
    return counts.join(size, "column").select("column", "value", "n")


def edge_rows(df: DataFrame, keys: Keys, n: int = 10) -> DataFrame:
    """The first and the last n rows as JSON texts: (part, place, row)."""
    names = [F.col(f"`{c}`") for c in df.columns]
    order = Window.orderBy("at")

    def edge(part: str, frame: DataFrame, up: bool) -> DataFrame:
        rows = frame.select(F.to_json(F.struct(*names)).alias("row"), F.monotonically_increasing_id().alias("at"))
        return rows.select(F.lit(part).alias("part"), (F.row_number().over(order) if up else n + 1 - F.row_number().over(order)).alias("place"), "row")

    return edge("head", head(df, keys, n), True).unionByName(edge("tail", tail(df, keys, n), False))


def document(df: DataFrame, name: str, sample: int = 5) -> DataFrame:
    """One row (name, profile): all of it as a JSON text."""
    columns = profile_columns(df).agg(F.sort_array(F.collect_list(F.struct("column", "type", "friendly", "rows", "nulls", "null_percent", "n", "min", "max", "mean", "median", "std", "distinct"))).alias("columns"))
    counts = small_counts(text_counts(df, CATEGORIES)).agg(F.sort_array(F.collect_list(F.struct("column", "n", "value"))).alias("counts"))  # at most 26 a column
    rows = df.limit(sample).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("r")).agg(F.collect_list("r").alias("sample"))
    both = columns.crossJoin(counts).crossJoin(rows)  # one row each
    return both.select(F.lit(name).alias("name"), F.to_json(F.struct("columns", "counts", "sample")).alias("profile"))


def table_profile(name: str, df: DataFrame) -> DataFrame:
    """(table_name, rows, columns): by one count."""
    return df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))


def table_columns(name: str, df: DataFrame, sample: int = 5) -> DataFrame:
    """(table_name, column, place, type, friendly, nullable, sample): a row for each column, with its values in the first rows as texts."""
    texts = [F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))).alias(f"c{k}") for k, f in enumerate(df.schema.fields)]
    first = df.limit(sample).select(*texts).agg(*[F.collect_list(f"c{k}").alias(f"c{k}") for k in range(len(df.columns))])
    facts = [F.struct(F.lit(f.name).alias("column"), F.lit(k).alias("place"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(friendly(f.dataType)).alias("friendly"), F.lit(f.nullable).alias("nullable"), F.col(f"c{k}").alias("sample")) for k, f in enumerate(df.schema.fields)]
    return first.select(F.lit(name).alias("table_name"), F.inline(F.array(*facts)))
