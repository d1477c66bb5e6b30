"""Euler tours of forests of bounded or unbounded shape: lists are ranked by contraction, subtree sums come from prefix sums.

A list is a table (arc, next, length): each arc names its successor (null at the end) and how many places it takes. It is ranked in rounds.
In each round tasks get the arcs of a block together and hang every arc of a chain that lies in one task's hands on the chain's first
arc, so only first arcs go on; rows of a round that were hung up keep (head, off). Any blocks give right ranks, good ones shorten more.
After the caller's blocks the list is shortened by coins: an arc that shows 0 joins its successor that shows 1, which removes a quarter.
When no more than ``small`` arcs are left, one task ranks them, and the rounds are undone in reverse by a join each. All work together is
linear in the arcs. Each round is written, so that a lost executor can't change a decision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import settle

#: Arcs that a task takes in hand at once, and that one task ranks in the end.
HAND, SMALL = 1 << 16, 1 << 15
#: Arcs of a block of prefix sums.
SUMS = 1 << 16


def chain(arc: np.ndarray, after: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(head, off, next, length) of each arc: its chain's first arc among these and the places before it; of heads the chain's successor and
    places, of others -1 and 0. ``after`` is -1 at the list's end."""
    n = len(arc)
    order = np.argsort(arc)
    found = np.minimum(np.searchsorted(arc[order], after), n - 1)
    inside = arc[order][found] == after
    succ = order[found]
    head, off = np.arange(n), np.zeros(n, np.int64)
    head[succ[inside]] = np.flatnonzero(inside)
    off[succ[inside]] = length[inside]
    while True:
        further = head[head]
        if (further == head).all():
            break
        off += np.where(further != head, off[head], 0)
        head = further
    tails = np.flatnonzero(~inside)
    follows, total = np.full(n, -1), np.zeros(n, np.int64)
    follows[head[tails]] = after[tails]
    total[head[tails]] = off[tails] + length[tails]
    return arc[head], off, follows, total


def contract(links: DataFrame, block: Column | None, blocks: list[str], hand: int = HAND) -> DataFrame:
    """(arc, head, off, next, length, blocks) of a round over (arc, next, length, blocks); without ``block`` one task takes all."""
    whole = block is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if not whole and sum(b.num_rows for b in held) >= hand:
                yield from done(held)
                held = []
        yield from done(held)

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        arc, length = (table.column(c).to_numpy() for c in ("arc", "length"))
        after = table.column("next").fill_null(-1).to_numpy()
        head, off, follows, total = chain(arc, after, length)
        arrays = [pa.array(arc), pa.array(head), pa.array(off), pa.array(follows, pa.int64(), mask=follows < 0), pa.array(total)]
        yield pa.RecordBatch.from_arrays([*arrays, *(table.column(b).combine_chunks() for b in blocks)], ["arc", "head", "off", "next", "length", *blocks])

    names = ["arc", "next", "length", *blocks]
    laid = links.select(*names).repartition(1).sortWithinPartitions("arc") if whole else links.select(*names, block.alias("__block")).repartition("__block").sortWithinPartitions("__block", "arc").select(*names)
    return laid.mapInArrow(run, ", ".join(f"{c} bigint" for c in ("arc", "head", "off", "next", "length", *blocks)))


def _coins(k: int) -> Column:
    def coin(c: Column) -> Column:
        return F.xxhash64(c, F.lit(k)).bitwiseAND(F.lit(1))

    return F.when((coin(F.col("arc")) == 0) & (coin(F.col("next")) == 1), F.col("next")).otherwise(F.col("arc"))


def rank(links: DataFrame, blocks: list[str], small: int = SMALL, hand: int = HAND) -> DataFrame:
    """(arc, pos), from 0, of the list (arc, next, length, and the columns ``blocks`` of the first rounds in turn)."""
    levels, left, k = [], links, 0
    while k < len(blocks) or left.count() > small:
        block = F.col(blocks[k]) if k < len(blocks) else _coins(k)
        levels.append(settle(contract(left, block, blocks, hand), f"list-{k}"))
        left = levels[-1].filter("head = arc").select("arc", "next", "length", *blocks)
        k += 1
    placed = contract(left, None, blocks).select("arc", F.col("off").alias("pos"))
    for k, level in enumerate(reversed(levels)):
        heads = placed.select(F.col("arc").alias("head"), "pos")
        placed = level.select("arc", "head", "off").join(heads, "head").select("arc", (F.col("pos") + F.col("off")).alias("pos"))
        if k % 4 == 3:
            placed = settle(placed, "list-placed")
    return placed


def running(rows: DataFrame, values: list[str], block: int = SUMS) -> DataFrame:
    """``rows`` with each of ``values`` summed over all positions ``pos`` up to the row's own; sums run within blocks of positions, and the
    blocks' totals, a row for each, are summed in one place."""
    cut = rows.withColumn("part", F.floor(F.col("pos") / block))
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("part").agg(*[F.sum(v).alias(v) for v in values]).select("part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"before_{v}") for v in values])
    summed = cut.withColumns({v: F.sum(v).over(inside) for v in values}).join(totals, "part")
    return summed.withColumns({v: F.col(v) + F.col(f"before_{v}") for v in values}).drop("part", *[f"before_{v}" for v in values])


def subtree_sums(placed: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """(nid, names): of each node the sums over its subtree, itself included. ``placed`` ranks the arcs 2 * nid (enter) and 2 * nid + 1
    (exit); ``values`` has (nid, names). A node counts where it is entered, so its subtree is what lies between its two arcs."""
    rows = placed.select(F.shiftright("arc", 1).alias("nid"), F.col("arc").bitwiseAND(F.lit(1)).alias("out"), "pos").join(values, "nid")
    weighed = rows.select("nid", "out", "pos", *[F.when(F.col("out") == 0, F.col(v)).otherwise(0).alias(v) for v in names], *[F.col(v).alias(f"own_{v}") for v in names])
    sums = running(weighed, names)
    return sums.groupBy("nid").agg(*[F.sum(F.when(F.col("out") == 1, F.col(v)).otherwise(F.col(f"own_{v}") - F.col(v))).alias(v) for v in names])
