"""Exact order statistics by group (X19, X22, D04): values at given ranks of many columns and groups at once, with bounded state.

1. A sketch of each group and column gives ``GRID`` pivots. Two of them enclose the wanted ranks.
2. One pass counts what lies below the enclosed stretch and groups the stretch by value, partial sums first; only its distinct values, about
   a hundredth, are shuffled, spread by value. Counts are exact: where a sketch has missed a rank, its stretch is opened to the end.
3. While a group has more than ``SMALL`` distinct values left, new pivots cut them into ranges, and those that hold a rank stay.
4. At most ``SMALL`` values a group are put in order.

Nulls don't count; a group of nothing else has no row. NaN is the greatest value. Equal values share ranks by their number.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.scratch import settle

#: Ranges that one round cuts a group into, the sketch's accuracy in ranks (1 / n of the rows), and the values of a group that one task orders.
GRID, ACCURACY, SMALL = 256, 2_000, 1 << 16


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of ``right``, a row for each group; null groups meet."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = functools.reduce(Column.__and__, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, same).drop(*[f"__r_{k}" for k in keys])


def _grid(value: str) -> Column:
    return F.percentile_approx(value, [k / GRID for k in range(1, GRID)], ACCURACY)


def _first_cut(rows: DataFrame, keys: list[str], facts: DataFrame) -> DataFrame:
    """(keys, side, v, w): the rows of each value (side 0) of the stretch between low and high, and of all below it (side -1, v null)."""
    known = _with(rows, facts.select(*keys, "low", "high"), keys)
    side = F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0)
    return known.withColumn("side", side).filter("side <= 0").withColumn("v", F.when(F.col("side") == 0, F.col("v"))).groupBy(*keys, "side", "v").agg(F.sum("w").alias("w"))


def _narrowed(values: DataFrame, keys: list[str], ranks: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Values and ranks after one more round, for the groups with more than ``small`` values."""
    large = values.groupBy(*keys).agg(F.count("*").alias("m"), _grid("v").alias("grid")).filter(F.col("m") > small).drop("m")
    large = settle(large, "rank-grids")
    # a group without grid is one range
    cut = _with_left(values, large, keys).withColumn("bucket", F.coalesce(F.size(F.filter("grid", lambda p: p < F.col("v"))), F.lit(0))).drop("grid")
    sums = cut.groupBy(*keys, "bucket").agg(F.sum("w").alias("w"))
    ends = sums.withColumn("end", F.sum("w").over(Window.partitionBy(*keys).orderBy("bucket")))  # GRID rows a group at most
    held = _with(ends, ranks, keys).withColumn("begin", F.col("end") - F.col("w"))
    holds = lambda r: (F.col("begin") <= F.col(r)) & (F.col(r) < F.col("end"))
    chosen = held.groupBy(*keys).agg(*[F.min(F.when(holds(r), F.col("bucket"))).alias(f"{r}_bucket") for r in ("lower", "upper")], F.min(F.when(holds("lower"), F.col("begin"))).alias("before"))
    chosen = settle(chosen, "rank-buckets")
    kept = _with(cut, chosen, keys).filter(F.col("bucket").between(F.col("lower_bucket"), F.col("upper_bucket"))).select(*keys, "v", "w")
    moved = _with(ranks, chosen.select(*keys, "before"), keys)
    return settle(kept, "rank-values"), moved.select(*keys, *[(F.col(r) - F.col("before")).alias(r) for r in ("lower", "upper")])


def _most(values: DataFrame, keys: list[str]) -> int:
    """Values of the group that has the most."""
    return values.groupBy(*keys).agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0


def _with_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = functools.reduce(Column.__and__, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, same, "left").drop(*[f"__r_{k}" for k in keys])


def quantiles(df: DataFrame, by: list[str], columns: list[str], q: float, how: str = "nearest", small: int = SMALL) -> DataFrame:
    """(by, column, quantile): of each group and column the value at rank q * (n - 1), rounded half up (``nearest``, in the columns' type if
    they share it) or between its neighbours (``linear``, a double)."""
    if how not in ("nearest", "linear") or not 0 <= q <= 1:
        raise ValueError(f"Unknown quantile: {how} {q}")
    kinds = {df.schema[c].dataType for c in columns}
    kind = kinds.pop() if len(kinds) == 1 and how == "nearest" else "double"
    groups = [f"g{k}" for k in range(len(by))]
    keys = [*groups, "place"]
    values = F.array(*[F.struct(F.lit(k).alias("place"), F.col(f"`{c}`").cast(kind).alias("v")) for k, c in enumerate(columns)])
    rows = df.select(*[F.col(f"`{b}`").alias(g) for b, g in zip(by, groups)], F.inline(values)).filter("v is not null").withColumn("w", F.lit(1).cast("long"))
    at = q * (F.col("n") - 1)
    lower, upper = (F.floor(at + 0.5),) * 2 if how == "nearest" else (F.floor(at), F.ceil(at))
    guess = rows.groupBy(*keys).agg(F.count("*").alias("n"), _grid("v").alias("grid")).withColumns({"lower": lower.cast("long"), "upper": upper.cast("long")})
    pivot = lambda r, step: F.get("grid", (F.floor(F.col(r) * GRID / F.col("n")) + step - 1).cast("int"))
    facts = settle(guess.select(*keys, "n", "lower", "upper", pivot("lower", -1).alias("low"), pivot("upper", 2).alias("high")), "rank-guess")
    found = settle(_first_cut(rows, keys, facts), "rank-stretch")
    sums = found.groupBy(*keys).agg(F.sum(F.when(F.col("side") < 0, F.col("w")).otherwise(0)).alias("under"), F.sum(F.when(F.col("side") == 0, F.col("w")).otherwise(0)).alias("within"), F.count_if(F.col("side") == 0).alias("m"))
    missed = (F.col("lower") < F.col("under")) | (F.col("upper") >= F.col("under") + F.col("within"))
    checked = settle(_with(facts, sums, keys), "rank-facts")
    any_missed, most = checked.agg(F.max(missed), F.max("m")).first()
    if any_missed:
        checked = settle(checked.withColumns({c: F.when(missed, F.lit(None)).otherwise(F.col(c)) for c in ("low", "high")}).withColumn("under", F.when(missed, 0).otherwise(F.col("under"))), "rank-facts")
        found = settle(_first_cut(rows, keys, checked), "rank-stretch")
        most = _most(found.filter("side = 0"), keys)
    left, ranks = found.filter("side = 0").select(*keys, "v", "w"), checked.select(*keys, *[(F.col(r) - F.col("under")).alias(r) for r in ("lower", "upper")])
    while (most or 0) > small:
        left, ranks = _narrowed(left, keys, ranks, small)
        most = _most(left, keys)
    ends = left.withColumn("end", F.sum("w").over(Window.partitionBy(*keys).orderBy("v")))  # at most ``small`` rows a group
    held = _with(ends, ranks, keys)
    picked = held.groupBy(*keys).agg(*[F.min(F.when((F.col("end") - F.col("w") <= F.col(r)) & (F.col(r) < F.col("end")), F.col("v"))).alias(f"at_{r}") for r in ("lower", "upper")])
    share = at - F.floor(at)
    value = F.col("at_lower") if how == "nearest" else F.when(share == 0, F.col("at_lower")).otherwise(F.col("at_lower") * (1 - share) + F.col("at_upper") * share)
    done = _with(picked, checked.select(*keys, "n"), keys)
    names = F.array(*[F.lit(c) for c in columns])
    return done.select(*[F.col(g).alias(b) for b, g in zip(by, groups)], F.get(names, F.col("place")).alias("column"), value.alias("quantile"))
