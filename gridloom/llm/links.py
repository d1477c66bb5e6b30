"""Connected components by Spark joins over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import settle


def _all_stars(edges: DataFrame) -> bool:
    """Is every node of the distinct ``edges`` (a, b) either a centre b alone, or the a of one edge alone? One aggregation."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.filter("up > 1 or (up = 1 and down = 1)").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; non-null longs): root is the least node that it is connected with.

    Large-star and small-star steps in turn: each node's larger neighbours, then its smaller ones, are hung on the least of its
    neighbourhood, until only stars are left; the rounds grow with the logarithm of the longest path. Every step is an aggregation and a
    join on node ids; a star's centre is only a key with an aggregated minimum.
    """
    clean = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    clean = settle(clean, "edges")
    while not _all_stars(clean):
        both = clean.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(clean.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = settle(large, "large-star")
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, large["a"] == low["u"]).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        clean = settle(small.filter("a <> b").distinct(), "small-star")
    return clean.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(clean.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
