"""Table verbs that Spark has no single call for."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import ranks
from gridloom.scratch import settle

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}


def repeated_keys(df: DataFrame, keys: list[str]) -> bool:
    return df.groupBy(*keys).count().filter("count > 1").limit(1).count() > 0


def join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str] | None = None, how: str = "inner", suffix: str = "_right", join_nulls: bool = False, validate: str = "m:m") -> DataFrame:
    """Join with the key columns of the left kept, clashing names of the right suffixed; ``validate`` (1:1, 1:m, m:1) demands unique keys."""
    if how not in JOINS:
        raise ValueError(f"Unknown join: {how}")
    right_on = right_on or left_on
    if validate[0] == "1" and repeated_keys(left, left_on) or validate[-1] == "1" and repeated_keys(right, right_on):
        raise ValueError(f"Keys are not unique as {validate} demands")
    taken = {c.lower() for c in left.columns}
    names = {c: c + suffix if c.lower() in taken else c for c in right.columns}
    r = right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    if how == "cross":
        return left.crossJoin(r)
    on = F.lit(True)
    for a, b in zip(left_on, right_on):
        on = on & (left[a].eqNullSafe(r[names[b]]) if join_nulls else left[a] == r[names[b]])
    out = left.join(r, on, JOINS[how])
    if how in ("semi", "anti"):
        return out
    if how in ("right", "full"):
        keys = {a: F.coalesce(left[a], r[names[b]]).alias(a) for a, b in zip(left_on, right_on)}
        return out.select(*[keys.get(c, left[c]) for c in left.columns], *[r[n] for c, n in names.items() if c not in right_on])
    return out.select(*[left[c] for c in left.columns], *[r[n] for c, n in names.items() if c not in right_on])


def unique(df: DataFrame, subset: list[str], keep: str = "any", order: str = "_row") -> DataFrame:
    """Rows with distinct ``subset``: any, the first or last by ``order``, or none of those that repeat."""
    if keep == "any":
        return df.dropDuplicates(subset)
    same = Window.partitionBy(*subset)
    if keep == "none":
        return df.withColumn("__n", F.count("*").over(same)).filter("__n = 1").drop("__n")
    by = same.orderBy(F.col(order) if keep == "first" else F.desc(order))
    return df.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def pivot(df: DataFrame, on: str, index: list[str], value: Column, values: list) -> DataFrame:
    """``value`` is an aggregate; ``values`` lists the new columns, so that no extra job looks for them."""
    return df.groupBy(*index).pivot(on, values).agg(value)


def unpivot(df: DataFrame, index: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(index, columns, "variable", "value")


def transpose(df: DataFrame, index: str, most: int = 1000) -> DataFrame:
    """Rows as columns, for small tables only."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"More than {most} rows")
    return df.transpose(F.col(index))


def first_last(column: str, order: str) -> tuple[Column, Column]:
    return F.min_by(column, order), F.max_by(column, order)


def quantile_nearest(df: DataFrame, by: list[str], column: str, q: float) -> DataFrame:
    """The value at the rounded rank q * (n - 1) among the non-null values of each group."""
    return ranks.quantiles(df, by, [column], q).select(*by, "quantile")


def aggregate(df: DataFrame, by: list[str], plain: list[Column], medians: dict[str, str] | None = None, distinct: dict[str, str] | None = None) -> DataFrame:
    """(by, ...): the aggregates ``plain``, exact medians and exact numbers of distinct values as {name: column}. No group's values meet in
    one task: medians are narrowed down, distinct values are spread by value before they are counted."""
    out = df.groupBy(*by).agg(*plain)
    if medians:
        found = ranks.quantiles(df, by, list(dict.fromkeys(medians.values())), 0.5, "linear")
        wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("column") == c, F.col("quantile"))).alias(name) for name, c in medians.items()])
        out = _left_by(out, wide, by)
    for name, c in (distinct or {}).items():
        counts = df.filter(F.col(c).isNotNull()).select(*by, F.col(c).alias("__v")).distinct().groupBy(*by).agg(F.count("*").alias(name))
        out = _left_by(out, counts, by).withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def _left_by(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Null groups meet."""
    renamed = right.select(*[F.col(b).alias(f"__r_{b}") for b in by], *[c for c in right.columns if c not in by])
    same = functools.reduce(Column.__and__, [left[b].eqNullSafe(renamed[f"__r_{b}"]) for b in by]) if by else F.lit(True)
    return left.join(renamed, same, "left").drop(*[f"__r_{b}" for b in by])


def as_of_layout(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Rows of both sides by ranges of (key, time), so that a key with many rows is cut into several: ``__part`` numbers the ranges in order.
    At one time right rows come first."""
    names = left.columns
    a = left.select(*names, F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__value"))
    b = right.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(*[F.col(c) if c in (key, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], F.lit(0).alias("__side"), F.col(value).alias("__value"))
    rows = a.unionByName(b)
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in names], "__value")  # rows of one key and time
    laid = rows.repartitionByRange(F.asc_nulls_first(key), F.asc_nulls_first(time), "__side", spread)
    return settle(laid.withColumn("__part", F.spark_partition_id()), "as-of")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each left row with the right's latest ``value`` at or before its time. Ranges of (key, time) are looked through in their own tasks; the
    last value of a key that goes on in the next range is carried over by one row a range. A null key or time matches nothing."""
    names = left.columns
    rows = as_of_layout(left, right, key, time, value)
    mine = F.when(F.col("__side") == 0, F.struct("__value"))
    run = Window.partitionBy("__part", key).orderBy(F.asc_nulls_first(time), "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("__last", F.last(mine, ignorenulls=True).over(run))
    # of each range: its first key asks, its last key gives; of one range the question comes first
    ends = rows.groupBy("__part").agg(F.min(key).alias("__first"), F.max(key).alias("__end"))
    given = rows.filter("__side = 0").join(F.broadcast(ends.select("__part", "__end")), "__part").filter(F.col(key) == F.col("__end"))
    given = given.groupBy("__part").agg(F.max_by(F.struct("__value"), F.col(time)).alias("__gives"))
    steps = ends.select("__part", F.col("__first").alias("__key"), F.lit(0).alias("__turn"), F.lit(None).cast(given.schema["__gives"].dataType).alias("__gives")).unionByName(
        ends.join(given, "__part").select("__part", F.col("__end").alias("__key"), F.lit(1).alias("__turn"), "__gives")
    )
    earlier = Window.partitionBy("__key").orderBy("__part", "__turn").rowsBetween(Window.unboundedPreceding, -1)  # two rows a range
    carried = steps.withColumn("__carried", F.last("__gives", ignorenulls=True).over(earlier)).filter("__turn = 0").select("__part", "__key", "__carried")
    found = seen.filter("__side = 1").join(F.broadcast(carried), "__part", "left")
    known = F.coalesce(F.col("__last"), F.when(F.col(key) == F.col("__key"), F.col("__carried")))
    return found.select(*names, F.when(F.col(time).isNotNull(), known)["__value"].alias(value))


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str) -> DataFrame:
    """Rows of ``left`` whose integer ``point`` lies in a right row's [low, high], of any lengths.

    An interval of n points belongs to the level of the least power of two above n, and touches at most two buckets of that width; a point has
    one bucket on each level that occurs, 63 at most. So an interval is at most two rows, however long it is, and its buckets are at most
    four times as long as it is. Nulls match nothing."""
    size = F.col(high).cast("decimal(20,0)") - F.col(low).cast("decimal(20,0)") + 1
    known = right.filter(F.col(low) <= F.col(high)).withColumn("__level", F.least(F.floor(F.log2(size.cast("double"))) + 1, F.lit(63)).cast("int"))
    levels = sorted(r[0] for r in known.select("__level").distinct().collect())
    bucket = lambda c: F.expr(f"shiftright(cast(`{c}` as bigint), __level)")
    ends = known.withColumn("__bucket", F.explode(F.array_distinct(F.array(bucket(low), bucket(high)))))
    points = left.filter(F.col(point).isNotNull()).withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumn("__bucket", bucket(point))
    return points.join(ends, ["__level", "__bucket"]).filter(F.col(point).between(F.col(low), F.col(high))).drop("__level", "__bucket")
