"""Prefix trie of conversations by the Euler-tour technique.

1. Turns are hashed where they are read, so texts never move. A conversation's turns are numbered by a range sort (nulls of ``turn`` first;
   turns that share a number by their hash), however long it is.
2. A prefix is known by the XOR of two 64-bit hashes of (depth, turn) over its turns; these run in blocks of depths. Equal prefixes are
   one node, made by one aggregation.
3. A node's children are numbered one after another. Each node gives an arc that enters and one that leaves; arcs name their successor:
   first child or own exit, next sibling or parent's exit.
4. ``euler.rank`` gives each arc its place in the tour: chains of one path are drawn together first, then runs of siblings, then paths with
   what hangs on them, then any. Prefix sums at the places give leaves and savings of every subtree.
5. Ids of the conversations that end in a node are joined in sorted pieces by range partitions; one chain of pieces gives the hash.

Nodes with the same least conversation lie on one path, so (conv_id, depth) names a node. Null role or text is empty. Rows without conv_id
take no part. Repeated rows are turns of their own. Other columns are not looked at. An empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import euler
from gridloom.llm.shared import settle
from gridloom.operators.order import with_row_index

#: Depths of one block of running hashes, children or depths of one block of arcs, ids of one piece of ends.
DEPTHS, FANOUT, PIECE = 1 << 12, 1 << 12, 1 << 12
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turn_hash(role: Column, text: Column) -> Column:
    """16 bytes that tell turns apart; null is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_hash, n_bytes): the turns of each conversation, numbered from 0."""
    hashed = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_hash(F.col("role"), F.col("text")).alias("turn_hash"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    rows = with_row_index(hashed, [("conv_id", True), ("turn", True), ("turn_hash", True)])
    firsts = rows.groupBy("conv_id").agg(F.min("_row").alias("first_row"))
    return rows.join(firsts, "conv_id").select("conv_id", (F.col("_row") - F.col("first_row")).alias("place"), "turn_hash", "n_bytes")


def shared_openings(turns: DataFrame, group: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that open like the first of their group: c begins with the first h turns of c - c % group, h = crc32(c) % longest, and
    goes on with its own after its first h. Gives (conv_id, depth, turn_hash, n_bytes), depth from 1, and all (conv_id), turnless ones too."""
    turns = settle(turns, "trie-turns")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("donor"), taken.alias("taken"))
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n"))
    convs = settle(convs.join(donors, "donor", "left").withColumn("got", F.least("taken", F.coalesce("donor_n", F.lit(0)))), "trie-conversations")
    own = turns.filter(F.col("place") >= taken).join(convs.select("conv_id", "got", "taken"), "conv_id")
    own = own.select("conv_id", (F.col("place") - F.col("taken") + F.col("got") + 1).alias("depth"), "turn_hash", "n_bytes")
    # at most longest - 1 turns of a donor, for the few conversations of its group
    given = turns.filter(F.col("place") < longest - 1).withColumnRenamed("conv_id", "donor").join(convs.select("conv_id", "donor", "taken"), "donor").filter("place < taken")
    return own.unionByName(given.select("conv_id", (F.col("place") + 1).alias("depth"), "turn_hash", "n_bytes")), convs.select("conv_id")


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, depth, turn_hash, n_bytes) with the key (k1, k2) of the prefix that ends there, and (p1, p2) of the one before."""
    rows = turns.withColumn("block", F.floor(F.col("depth") / DEPTHS)).withColumns({f"f{k}": F.xxhash64(F.lit(k), "depth", "turn_hash") for k in (1, 2)})
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({f"r{k}": F.bit_xor(f"f{k}").over(inside) for k in (1, 2)})
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "block").agg(*[F.bit_xor(f"f{k}").alias(f"f{k}") for k in (1, 2)])
    before = sums.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"f{k}").over(earlier), F.lit(0)).alias(f"b{k}") for k in (1, 2)])
    keyed = run.join(before, ["conv_id", "block"]).withColumns({f"k{k}": F.col(f"r{k}").bitwiseXOR(F.col(f"b{k}")) for k in (1, 2)})
    return keyed.select("conv_id", "depth", "k1", "k2", *[F.col(f"k{k}").bitwiseXOR(F.col(f"f{k}")).alias(f"p{k}") for k in (1, 2)], "turn_hash", "n_bytes")


def nodes_of(found: DataFrame, convs: DataFrame) -> DataFrame:
    """(nid, conv_id, depth, parent_conv_id, k1, k2, n_convs, turn_hash, n_bytes): nid numbers nodes by depth, parent and conv_id, from 0."""
    nodes = found.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("p1", "p2", "turn_hash", "n_bytes")])
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("p1"), zero.alias("p2"), F.lit(None).cast("binary").alias("turn_hash"), zero.alias("n_bytes"))
    nodes = settle(nodes.unionByName(root), "trie-nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    placed = nodes.filter("depth > 0").join(parents, ["depth", "p1", "p2"]).unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    numbered = with_row_index(placed.drop("p1", "p2"), [("depth", True), ("parent_conv_id", True), ("conv_id", True)])
    return numbered.withColumn("nid", F.col("_row") - 1).drop("_row")


def tour(nodes: DataFrame) -> DataFrame:
    """(arc, next, length, path, side, over) of nodes with (nid, conv_id, depth, parent_conv_id, first, last, up): an arc 2 * nid enters a node
    and 2 * nid + 1 leaves it. path, side and over are blocks: of one path, of siblings, and of a path with what hangs on it."""
    enter, leave = F.col("nid") * 2, F.col("nid") * 2 + 1
    goes_in = F.coalesce(F.col("first") * 2, leave)
    goes_out = F.when(F.col("depth") == 0, F.lit(None)).otherwise(F.coalesce(F.col("up") * 2 + 1, enter + 2))
    arcs = nodes.select(
        F.explode(F.array(F.struct(enter.alias("arc"), goes_in.alias("next")), F.struct(leave.alias("arc"), goes_out.alias("next")))).alias("way"),
        F.xxhash64("conv_id", F.floor(F.col("depth") / DEPTHS)).alias("path"),
        F.xxhash64("parent_conv_id", "depth", F.floor(F.col("nid") / FANOUT)).alias("side"),
        F.xxhash64(F.coalesce("parent_conv_id", "conv_id"), F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / DEPTHS)).alias("over"),
    )
    return arcs.select("way.arc", "way.next", F.lit(1).cast("long").alias("length"), "path", "side", "over")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, comma-joined, each with its first id."""
    names = ["depth", "k1", "k2", "id", "ids"]
    key, held = None, []

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in list(zip(*rows))[:4]), pa.array([r[4] for r in rows], pa.string())], names)

    for batch in batches:
        rows = []
        for depth, k1, k2, c in zip(*(batch.column(n).to_pylist() for n in ("depth", "k1", "k2", "conv_id"))):
            if (depth, k1, k2) != key or len(held) == PIECE:
                if held:
                    rows.append((*key, held[0], ",".join(map(str, held))))
                key, held = (depth, k1, k2), []
            held.append(c)
        if rows:
            yield out(rows)
    if held:
        yield out([(*key, held[0], ",".join(map(str, held)))])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, sha = None, None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3], pa.string())], ["depth", "k1", "k2", "ends_sha256"])

    for batch in batches:
        rows = []
        for depth, k1, k2, ids in zip(*(batch.column(n).to_pylist() for n in ("depth", "k1", "k2", "ids"))):
            if (depth, k1, k2) != key:
                if key is not None:
                    rows.append((*key, sha.hexdigest()))
                key, sha = (depth, k1, k2), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if rows:
            yield out(rows)
    if key is not None:
        yield out([(*key, sha.hexdigest())])


def ends(found: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes in which conversations end."""
    last = found.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("at"))
    each = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"at.{c}", F.lit(0).cast("long")).alias(c) for c in ("depth", "k1", "k2")])
    keys = ["depth", "k1", "k2"]
    pieces = each.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id").select(*keys, "conv_id").mapInArrow(_pieces, "depth bigint, k1 bigint, k2 bigint, id bigint, ids string")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(_hashed, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, small: int = euler.SMALL, hand: int = euler.HAND) -> DataFrame:
    """Every node of the trie of ``turns`` (conv_id, depth from 1 without gaps, turn_hash, n_bytes), of the conversations ``convs`` (conv_id).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_hash (of the node's last turn)."""
    found = settle(prefixes(turns), "trie-prefixes")
    nodes = nodes_of(found, convs)
    kids = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.min("nid").alias("first"), F.max("nid").alias("last"), F.count("*").alias("n_children"))
    known = settle(nodes.join(kids, ["conv_id", "depth"], "left"), "trie-family")
    lasts = known.filter("last is not null").select(F.col("last").alias("nid"), F.col("nid").alias("up"))
    linked = known.join(lasts, "nid", "left")
    placed = euler.rank(tour(linked), ["path", "side", "over"], small, hand)
    values = known.select("nid", F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    sums = euler.subtree_sums(placed, values, ["n_leaves", "saved_tokens"])
    done = known.join(sums, "nid").join(ends(found, convs), ["depth", "k1", "k2"], "left")
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), "turn_hash")


def with_last_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` of ``trie`` with the role and text of each one's last turn; the root has none."""
    turns = conversations.groupBy(turn_hash(F.col("role"), F.col("text")).alias("turn_hash")).agg(*[F.first(F.coalesce(c, F.lit(""))).alias(c) for c in ("role", "text")])
    return nodes.join(turns, "turn_hash", "left")


def digest(conversations: DataFrame, small: int = euler.SMALL, hand: int = euler.HAND) -> DataFrame:
    turns, convs = shared_openings(turns_of(conversations))
    return trie(turns, convs, small, hand).drop("turn_hash")
