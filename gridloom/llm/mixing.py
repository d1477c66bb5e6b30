"""Mixing sources to target weights, in SQL functions only.

Token shares p of the sources are raised to an exponent a and normalised; a is found by bisection so that the weights meet a target
entropy, or so that no source is repeated more often than a limit. The weights times a token budget give each source's budget. A
source is dealt by hash into blocks of about ``block_tokens`` tokens. Each epoch has a permutation of the source's blocks, drawn from
(seed, source, epoch) as a swap-or-not shuffle, and an order of the documents within a block, drawn likewise. The budget takes whole
epochs as often as it goes, then the blocks that stand first in the next epoch's permutation, and of the last one the first documents.

Null sources are one source. A document's tokens are its words; documents without tokens cost nothing and are taken once. Repeated
rows are dealt alike. Texts are counted whole, however long. An empty table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import settle


@dataclass(frozen=True)
class Target:
    """One of: ``entropy`` as a share of the greatest possible (0 to 1), or ``repeats``, how often a source's text may be used.

    ``budget``: tokens of the mix; None: so many that the source used least is used once.
    """

    repeats: float | None = 2.0
    entropy: float | None = None
    budget: float | None = None
    block_tokens: int = 65536
    seed: int = 7


#: Exponents tried at once, and rounds: the interval shrinks by 17 in each.
TRIED, ROUNDS = 16, 7
#: A running sum over a source's blocks goes by runs of 2**12 blocks first, so that no task sorts all blocks of a large source.
RUN_BITS = 12
#: Rounds of the swap-or-not shuffle.
SWAPS = 16


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """(__key, __rank, __tokens) beside all columns: the source, 63 bits in hashed order, the tokens. Rows without doc_id differ by their text."""
    return docs.withColumns(
        {
            "__key": F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source"))),
            "__rank": F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("order")), 1),
            "__tokens": token_count(F.col("text")),
        }
    )


def exponent(sources: DataFrame, target: Target) -> float:
    """The exponent in 0..1 that meets ``target``: each round tries many at once in one aggregation over the sources."""
    low, high = 0.0, 1.0
    p = sources.filter("tokens > 0")
    for _ in range(ROUNDS):
        step = (high - low) / (TRIED + 1)
        tried = [low + step * (k + 1) for k in range(TRIED)]
        rows = p.select("share", F.explode(F.array(*[F.lit(x) for x in tried])).alias("a")).withColumn("w", F.pow("share", F.col("a")))
        found = rows.groupBy("a").agg(
            F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.max(F.col("w") / F.col("share")).alias("most"), F.min(F.col("w") / F.col("share")).alias("least"), F.count("*").alias("n"), F.first("share").alias("any")
        )
        total = F.lit(target.budget) / F.lit(sources.agg(F.sum("tokens")).first()[0] or 1) if target.budget else None
        entropy = (F.log("z") - F.col("wl") / F.col("z")) / F.greatest(F.log(F.col("n").cast("double")), F.lit(1e-12))
        repeats = F.col("most") / F.col("least") if total is None else F.col("most") / F.col("z") * total
        # both fall as the exponent rises from 0 (equal weights) to 1 (natural shares)
        fits = entropy >= target.entropy if target.entropy is not None else repeats > target.repeats
        row = found.agg(F.max(F.when(fits, F.col("a"))).alias("a")).first()
        best = row["a"] if row else None
        low, high = (low, tried[0]) if best is None else (best, min(high, best + step))
    return low if target.entropy is not None else high


def plan(docs: DataFrame, target: Target) -> DataFrame:
    """A row for each source: key, tokens, share, weight, epochs, blocks, and what it gives: every document ``full`` times; once more those of
    blocks up to position ``whole`` of the next epoch's permutation, and of the block at ``part`` those whose turn is at most ``cut``.

    So the mix needs no table of blocks beside the documents, however many there are."""
    counted = settle(keyed(docs.select("doc_id", "source", "text")).select("__key", "__rank", "__tokens"), "mix-tokens")
    sources = counted.groupBy(F.col("__key").alias("key")).agg(F.sum("__tokens").alias("tokens"))
    total = counted.agg(F.sum("__tokens")).first()[0] or 0
    sources = settle(sources.withColumn("share", F.try_divide(F.col("tokens").cast("double"), F.lit(float(total)))), "mix-sources")
    a = exponent(sources, target)
    raised = sources.withColumn("raised", F.when(F.col("tokens") > 0, F.pow("share", F.lit(a))).otherwise(0.0))
    z, least = raised.filter("tokens > 0").agg(F.sum("raised"), F.min(F.col("raised") / F.col("share"))).first()
    budget = target.budget or (float(total) * (z or 1.0) / (least or 1.0))
    weights = raised.select("key", "tokens", "share", (F.col("raised") / F.lit(z or 1.0)).alias("weight"))
    weights = weights.withColumn("epochs", F.coalesce(F.try_divide(F.col("weight") * budget, F.col("tokens").cast("double")), F.lit(1.0)))
    weights = weights.withColumn("epochs", F.when(F.abs(F.col("epochs") - F.round("epochs")) < 1e-6, F.round("epochs")).otherwise(F.col("epochs")))
    weights = weights.withColumn("want", (F.col("epochs") - F.floor("epochs")) * F.col("tokens"))
    weights = settle(weights.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / target.block_tokens)).cast("int")), "mix-weights")
    # documents without tokens are taken once whatever the cut
    dealt = counted.filter("__tokens > 0").join(weights.select(F.col("key").alias("__key"), "blocks", "want", F.floor("epochs").cast("int").alias("epoch")), "__key")
    dealt = dealt.withColumn("block", position(block(F.col("__rank"), F.col("blocks"), target), F.col("blocks"), F.col("__key"), F.col("epoch"), target)).withColumn("turn", turn(F.col("__rank"), F.col("epoch"), target))
    sizes = settle(dealt.groupBy("__key", "block", "want").agg(F.sum("__tokens").alias("size")), "mix-blocks")
    runs = _running(sizes.withColumn("run", F.shiftright("block", RUN_BITS)).groupBy("__key", "run", "want").agg(F.sum("size").alias("size")), ["__key"], "run")
    here = runs.filter("begin <= want and want < end").select("__key", "run", F.col("begin").alias("base"))
    inside = sizes.withColumn("run", F.shiftright("block", RUN_BITS)).join(here, ["__key", "run"])
    ends = _running(inside, ["__key", "run", "base"], "block").withColumns({"begin": F.col("begin") + F.col("base"), "end": F.col("end") + F.col("base")})
    split = (F.col("begin") < F.col("want")) & (F.col("want") < F.col("end"))
    cuts = ends.groupBy("__key").agg(
        F.coalesce(F.max(F.when(F.col("end") <= F.col("want"), F.col("block"))), F.shiftleft(F.max("run"), RUN_BITS) - 1).alias("whole"),
        F.max(F.when(split, F.col("block"))).alias("part"), F.max(F.when(split, F.col("want") - F.col("begin"))).alias("room"),
    )
    cuts = settle(cuts, "mix-cuts")
    last = dealt.join(cuts.select("__key", F.col("part").alias("block"), "room"), ["__key", "block"]).withColumn("sum", F.sum("__tokens").over(Window.partitionBy("__key", "block").orderBy("turn")))
    ranks = last.filter("sum <= room").groupBy("__key").agg(F.max("turn").alias("cut"))
    found = weights.join(cuts.join(ranks, "__key", "left").withColumnRenamed("__key", "key"), "key", "left")
    return settle(
        found.select("key", "tokens", "share", "weight", "epochs", "blocks", F.floor("epochs").cast("int").alias("full"), *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("whole", "part", "cut")]), "mix-plan"
    )


def _running(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` with ``begin`` and ``end`` of each one's stretch of ``size``, laid end to end."""
    end = F.sum("size").over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("end", end).withColumn("begin", F.col("end") - F.col("size"))


def block(rank: Column, blocks: Column, target: Target) -> Column:
    return F.pmod(F.xxhash64(rank, F.lit(target.seed)), blocks).cast("int")


def position(block: Column, blocks: Column, key: Column, epoch: Column, target: Target) -> Column:
    """Where a block stands, from 0, in its source's permutation of the epoch.

    In each round block x has a mate, a drawn number less x modulo the blocks, and a bit drawn for the two of them says whether they swap;
    every round, and so the whole, is a permutation of any number of blocks, found for one block without a table of the others."""

    def swap(x: Column, r: Column) -> Column:
        mate = F.pmod(F.xxhash64(F.lit(target.seed), key, epoch, r) - x, blocks).cast("int")
        return F.when(F.xxhash64(F.lit(target.seed), key, epoch, r, F.greatest(x, mate)) < 0, mate).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(SWAPS)), block, swap)


def turn(rank: Column, epoch: Column, target: Target) -> Column:
    """63 bits by which the documents of a block are ordered in the epoch."""
    return F.shiftrightunsigned(F.xxhash64(rank, epoch, F.lit(target.seed), F.lit("turn")), 1)


def mix(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """A row for each time a document is taken: all columns of ``docs`` (but those that start with two underscores) and ``__key``, ``__tokens``,
    ``__weight``, ``__block``, ``__epoch`` from 0, ``__position`` of the block in the epoch's permutation and ``__place`` (0 to 1): in its order,
    any run of the mix holds the sources by their weights.

    The texts meet only the table of sources."""
    given = plan(docs, target).select(F.col("key").alias("__key"), *[F.col(c).alias(f"__{c}") for c in ("weight", "blocks", "epochs", "full", "whole", "part", "cut")])
    dealt = keyed(docs).join(given, "__key").withColumn("__block", block(F.col("__rank"), F.col("__blocks"), target))
    last = F.when((F.col("__tokens") == 0) | ((F.col("__whole") < 0) & (F.col("__part") < 0)), F.greatest(F.col("__full") - 1, F.lit(0))).otherwise(F.col("__full"))
    tried = dealt.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.when(F.col("__tokens") == 0, 0).otherwise(last))))
    tried = tried.withColumn("__position", position(F.col("__block"), F.col("__blocks"), F.col("__key"), F.col("__epoch"), target)).withColumn("__turn", turn(F.col("__rank"), F.col("__epoch"), target))
    within = (F.col("__position") <= F.col("__whole")) | ((F.col("__position") == F.col("__part")) & (F.col("__turn") <= F.col("__cut")))
    taken = tried.filter((F.col("__tokens") == 0) | (F.col("__epoch") < F.col("__full")) | within)
    # blocks are drawn by hash, so each holds about as many tokens
    place = F.least(F.lit(1.0), (F.col("__epoch") + (F.col("__position") + F.col("__turn") / F.lit(2.0**63)) / F.col("__blocks")) / F.greatest("__epochs", F.lit(1e-9)))
    made = ("__key", "__tokens", "__weight", "__block", "__epoch", "__position", "__place")
    return taken.withColumn("__place", place).select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("__")], *made)
