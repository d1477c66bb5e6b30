"""N-gram Jaccard join: an LSH forest of MinHash prefixes proposes ties, exact Jaccard verifies them.

1. Every text gets its MinHash values over all shingles of five words. Texts that are equal form one class; its least doc_id stands for it.
2. Each tree orders some of the values as a label; texts with equal prefixes form a node of its trie. In a node, sorted texts are tied to
   their neighbours and to the node's first, as many ties as texts. The task that holds the node estimates their likeness from the values;
   ties far below the threshold never leave it.
3. Texts meet at the longest prefix first. Each one's best tie is verified on the exact shingle sets; what holds forms the first classes.
   Then the prefix is shortened, to the one at which a pair at the threshold is found with the target recall (trees share values, so that
   recall is simulated); only ties between texts not yet in one class are estimated and verified.
4. Connected components of the verified ties are the classes. So texts that are merely somewhat alike, as pages of one template, are
   never gathered, and a class costs ties in proportion to its texts.
5. Nodes with more members than neighbours meet all, and of more than one class, are then compared in full, in cells of two blocks: texts that
   hang together by likely pairs of different classes form a crowd, and in a crowd every pair of texts of different classes is verified on the
   shingle sets. So no pair that meets in a node is left out, however crowded; the cost is quadratic in the texts of a crowd outside its
   largest class.
6. What is left are pairs that meet in no node, or whose likeness was estimated too low. A prefix filter finds them without chance: two texts at the
   threshold share a shingle among the first fifth of both in any one order of all shingles. Texts of different classes (and of no crowd in
   common) that share one there, and whose sizes and places allow the threshold, are verified too. So no link is lost.
7. For the number of links, the texts of a class meet in cells of two blocks of at most ``block`` texts, so that no class falls to one task;
   a cell gives back one count for each text.

Null texts and texts without words have no shingles and no links (equal ones are copies of one another). A text of fewer than five words
has one shingle of all its words. Texts are read whole, however long. Rows with null doc_id have null class and no links. Where a doc_id
repeats with other texts, each row has its own class. Extra columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.links import components
from gridloom.llm.shared import blocks, mix, settle, shingle_hashes, text_bytes


#: Rows of nodes that a task takes in hand at once.
HAND = 1 << 14
#: Bits of the map that tells which texts a step asks for.
SPOTS = 1 << 23
#: Shingles of a stretch of texts in which frequent ones are counted.
STRETCH = 1 << 22


@dataclass(frozen=True)
class Settings:
    similarity: float = 0.8
    size: int = 5
    #: MinHash values of a text, trees, and the longest prefix of a tree's label.
    values: int = 128
    trees: int = 48
    longest: int = 11
    recall: float = 0.999
    #: Ties with a lower estimated likeness are not verified; four standard errors below the threshold.
    loose: float = 0.66
    block: int = 128
    #: Members of a trie node that are sorted as one list, and sorted neighbours that a text still without its class is tied to; at the longest
    #: prefix, where no class is known yet, one neighbour does.
    share: int = 4096
    beside: int = 24
    #: Texts in a block of a crowded node, or of the texts that share a shingle of their prefixes.
    crowd: int = 512
    #: Shingles that come last in the order that prefixes are cut from: the most frequent ones of those that a stretch of texts holds ``often``.
    #: Any order finds all pairs; with frequent shingles last, fewer texts share one.
    last: int = 1 << 16
    often: int = 4
    seed: int = 17
    #: Simulated pairs that the prefix length is taken from.
    draws: int = 100_000


@functools.cache
def recalls(settings: Settings) -> tuple[float, ...]:
    """For each prefix length from 0 the share of pairs at the threshold that meet in some tree, by drawing which values agree: the trees share
    values, so that their chances don't multiply."""
    labels = forest(settings)[2]
    rng = np.random.default_rng(settings.seed + 2)
    met = np.zeros(settings.longest + 1)
    for _ in range(settings.draws // 1000):
        same = rng.random((1000, settings.values)) < settings.similarity
        alike = np.cumprod(same[:, labels], axis=2).any(axis=1).sum(axis=0)
        met += np.concatenate([[1000], alike])
    return tuple(met / (settings.draws // 1000 * 1000))


def prefix_length(settings: Settings) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree with the target recall."""
    return next((depth for depth in range(settings.longest, 1, -1) if recalls(settings)[depth] >= settings.recall), 1)


def forest(settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors and masks of the hash functions, and for each tree the values that make up its label."""
    rng = np.random.default_rng(settings.seed)
    factors = (rng.integers(0, 1 << 32, settings.values, dtype=np.uint64) | 1).astype(np.uint32)
    masks = rng.integers(0, 1 << 32, settings.values, dtype=np.uint64).astype(np.uint32)
    labels = np.array([rng.permutation(settings.values)[: settings.longest] for _ in range(settings.trees)])
    return factors, masks, labels


def minhash(hashes: np.ndarray, owner: np.ndarray, n: int, factors: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """(n, values) least values of each text under each function; all ones for texts without shingles."""
    out = np.full((n, len(factors)), 0xFFFFFFFF, np.uint32)
    if len(hashes):
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        who = owner[starts]
        for k in range(len(factors)):
            value = short ^ masks[k]
            value *= factors[k]
            value ^= value >> np.uint32(15)
            out[who, k] = np.minimum.reduceat(value, starts)
    return out


def signatures(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, digest, sig, labels): a byte of each MinHash value, and each tree's label.

    A label has 52 bits of a hash of its prefix, then 4 bits of each of the next three values: sorted labels are a sorted trie."""
    depth = prefix_length(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, masks, labels = forest(settings)
        turn = np.random.default_rng(settings.seed + 1).integers(0, 1 << 63, settings.longest, dtype=np.uint64) | np.uint64(1)
        for batch in blocks(batches, "text", 1 << 19):
            data, offsets = text_bytes(batch.column("text"))
            hashes, owner = shingle_hashes(data, offsets, settings.size)
            n = batch.num_rows
            values = minhash(hashes, owner, n, factors, masks)
            some = np.bincount(owner, minlength=n) > 0
            found = np.zeros((n, len(labels)), np.uint64)
            for t, label in enumerate(labels):
                found[:, t] = (values[:, label[:depth]].astype(np.uint64) * turn[:depth]).sum(axis=1)
            mix(found.reshape(-1))
            found &= ~np.uint64(0xFFF)
            for t, label in enumerate(labels):
                for k, value in enumerate(label[depth : depth + 3]):
                    found[:, t] |= (values[:, value] >> np.uint32(28)).astype(np.uint64) << np.uint64(8 - 4 * k)
            lists = np.concatenate([[0], np.cumsum(np.where(some, len(labels), 0))]).astype(np.int32)
            small = np.ascontiguousarray((values & np.uint32(255)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array([row.tobytes() for row in small], pa.binary()), pa.ListArray.from_arrays(lists, pa.array(found[some].ravel().view(np.int64)))],
                ["doc_id", "digest", "sig", "labels"],
            )

    return docs.mapInArrow(run, "doc_id bigint, digest binary, sig binary, labels array<bigint>")


def trie_members(reps: DataFrame, settings: Settings) -> DataFrame:
    """(nid, tree, label, shares) of (nid, labels) in nodes of the shortest prefix that more than one text reaches; only they go on."""
    rows = reps.select("nid", F.posexplode("labels").alias("tree", "label")).withColumn("prefix", F.shiftright("label", 12))
    shared = rows.groupBy("tree", "prefix").agg(F.min("nid").alias("first"), F.max("nid").alias("last"), F.count("*").alias("n")).filter("first <> last")
    shares = F.ceil(F.col("n") / settings.share).cast("int").alias("shares")
    return rows.join(shared.select("tree", "prefix", shares), ["tree", "prefix"]).select("nid", "tree", "label", "shares")


def met_lists(members: DataFrame, cuts: list[int], neighbours: int, settings: Settings) -> DataFrame:
    """(a, near): for a text the others, as (b, estimate), that it meets in a node, where their estimated likeness reaches ``loose`` and the two are
    of different classes so far.

    ``members`` has (nid, tree, label, shares, sig, root). In its node, sorted by label, each text meets the first one of its prefix, for the
    label but for each number of last bits in ``cuts``, and its next ``neighbours``. A node of more members than a task should sort is cut
    into shares; its first member comes to each. Estimates are made where the node lies, so only likely pairs leave it, as one list for a text:
    that of the greater nid for neighbours, and never that of a node's first one, so that no list is long."""
    width, names = settings.values, ["tree", "prefix", "share", "lead", "label", "nid", "root", "sig"]

    def pairs_of(table: pa.Table) -> pa.RecordBatch:
        tree, prefix, share, lead, label, nid, root = (table.column(c).to_numpy() for c in names[:-1])
        sigs = text_bytes(table.column("sig").combine_chunks())[0].reshape(-1, width)
        n = len(nid)
        new = np.ones(n, bool)
        new[1:] = (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1]) | (share[1:] != share[:-1])
        group = np.cumsum(new)
        left, right = [], []

        def meet(i: np.ndarray, j: np.ndarray) -> None:
            """In the list of i comes j."""
            differ = (root[i] != root[j]) & (nid[i] != nid[j])
            left.append(i[differ]), right.append(j[differ])

        every = np.arange(n)
        for k in range(1, neighbours + 1):
            i = every[: max(n - k, 0)]
            i = i[group[i] == group[i + k]]
            later = (nid[i + k] > nid[i]) | (lead[i] == 1)  # the first one comes to every share
            meet(np.where(later, i + k, i), np.where(later, i, i + k))
        for cut in cuts:
            start = new.copy()
            start[1:] |= label[1:] >> cut != label[:-1] >> cut
            meet(every, np.maximum.accumulate(np.where(start, every, 0)))
        if lead.any():
            head = np.maximum.accumulate(np.where(new, every, 0))
            led = every[lead[head] == 1]
            meet(led, head[led])
        i, j = np.concatenate(left), np.concatenate(right)
        _, once = np.unique(np.stack([nid[i], nid[j]]), axis=1, return_index=True)  # by the list's text
        i, j = i[once], j[once]
        alike = np.concatenate([(sigs[i[c]] == sigs[j[c]]).mean(axis=1) for c in np.array_split(np.arange(len(i)), max(1, len(i) // 8192))]) if len(i) else np.zeros(0)
        likely = alike >= settings.loose
        a, b, alike = nid[i[likely]], nid[j[likely]], alike[likely]
        start = np.flatnonzero(np.diff(a, prepend=a[:1] - 1))
        near = pa.StructArray.from_arrays([pa.array(b), pa.array(alike)], ["b", "estimate"])
        return pa.RecordBatch.from_arrays([pa.array(a[start]), pa.ListArray.from_arrays(np.append(start, len(a)).astype(np.int32), near)], ["a", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < HAND:
                continue
            table = pa.Table.from_batches(held)
            # a node stays whole: the last one waits for its end
            last = [table.column(c).to_numpy() for c in names[:3]]
            cut = int(np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in last]))[-1:].sum()) + 1 if any((x != x[-1]).any() for x in last) else 0
            if cut:
                yield pairs_of(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if sum(b.num_rows for b in held):
            yield pairs_of(pa.Table.from_batches(held))

    rows = members.select("tree", F.shiftright("label", 12).alias("prefix"), F.pmod(F.xxhash64("nid"), F.col("shares")).cast("int").alias("share"), F.lit(0).alias("lead"), "label", "nid", "root", "sig", "shares")
    leads = rows.filter("shares > 1").groupBy("tree", "prefix").agg(F.min(F.struct("label", "nid", "root", "sig", "shares")).alias("first"))
    leads = leads.select("tree", "prefix", "first.*").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("lead", F.lit(1))
    laid = rows.unionByName(leads).select(*names).repartition("tree", "prefix", "share").sortWithinPartitions("tree", "prefix", "share", F.desc("lead"), "label", "nid")
    lists = laid.mapInArrow(run, "a bigint, near array<struct<b:bigint,estimate:double>>")
    # a text has at most 2 * neighbours + len(cuts) + 1 others from each tree
    return lists.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def ties(members: DataFrame, cuts: list[int], neighbours: int, settings: Settings) -> DataFrame:
    """(a, b, estimate), a > b: each pair of the lists once."""
    rows = met_lists(members, cuts, neighbours, settings).select("a", F.inline("near"))
    return rows.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "estimate").distinct()


def _distinct_shingles(texts: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text behind one another, and the number of each one's text."""
    data, offsets = text_bytes(texts)
    hashes, owner = shingle_hashes(data, offsets, settings.size)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def shingle_sets(texts: pa.Array, settings: Settings) -> pa.Array:
    """The sorted distinct shingle hashes of each text as bytes."""
    hashes, owner = _distinct_shingles(texts, settings)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    return pa.array([hashes[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())


def parities(texts: pa.Array, settings: Settings) -> pa.Array:
    """For each text the number of its shingles, then a bit for each of its cells, two to four a shingle, by the low bits of the hashes: is the
    number of shingles there odd? As 64-bit numbers in bytes."""
    hashes, owner = _distinct_shingles(texts, settings)
    sizes = np.bincount(owner, minlength=len(texts))
    cells = np.maximum(64, 1 << np.ceil(np.log2(2 * np.maximum(sizes, 1))).astype(np.int64))
    start = np.cumsum(cells) - cells
    held = np.bincount(start[owner] + (hashes & (cells[owner] - 1).astype(np.uint64)).astype(np.int64), minlength=int(cells.sum()))
    bits = np.packbits((held & 1).astype(np.uint8), bitorder="little").tobytes()
    return pa.array([int(n).to_bytes(8, "little") + bits[i // 8 : (i + k) // 8] for n, i, k in zip(sizes, start, cells)], pa.binary())


def in_common(mine: np.ndarray, theirs: np.ndarray) -> tuple[float, float]:
    """Sizes of what two sorted sets have in common, and of what they hold together."""
    if not (len(mine) and len(theirs)):
        return 0, 1
    at = np.searchsorted(mine, theirs)
    at[at == len(mine)] = 0
    both = int((mine[at] == theirs).sum())
    return both, len(mine) + len(theirs) - both


def most_in_common(mine: np.ndarray, theirs: np.ndarray) -> tuple[float, float]:
    """As ``in_common`` from ``parities``, the most that is possible: each odd cell of the two together holds a shingle that only one has. The
    longer row of cells is folded; parities of folded cells are those of their sum."""
    sizes, cells = (int(mine[0]), int(theirs[0])), min(len(mine), len(theirs)) - 1
    odd = np.bitwise_xor.reduce(mine[1:].reshape(-1, cells)) ^ np.bitwise_xor.reduce(theirs[1:].reshape(-1, cells))
    both = min(*sizes, (sum(sizes) - int(np.bitwise_count(odd).sum())) / 2)
    return both, sum(sizes) - both


def of_texts(texts: DataFrame, asked: DataFrame, make: Callable[[pa.Array, Settings], pa.Array], settings: Settings) -> DataFrame:
    """(nid, hashes): what ``make`` gives for the texts of ``asked`` (nid, doc_id, digest). A bitmap of bounded size goes out with the tasks, so that
    few other texts are worked on where they lie, and no text is shuffled."""
    spot = F.pmod(F.xxhash64("digest"), F.lit(SPOTS)) + 1
    rows = asked.groupBy(F.bitmap_bucket_number(spot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")).collect()  # bounded
    wanted = np.zeros((SPOTS >> 15, 1 << 15), bool)
    for r in rows:
        wanted[r.part - 1] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
    packed = np.packbits(wanted.reshape(-1)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            mine = batch.filter(pa.array(wanted[batch.column("spot").to_numpy() - 1]))
            for block in blocks([mine], "text", 1 << 19):
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("digest"), make(block.column("text"), settings)], ["doc_id", "digest", "hashes"])

    made = texts.filter("doc_id is not null").select("doc_id", "digest", spot.alias("spot"), "text").mapInArrow(run, "doc_id bigint, digest binary, hashes binary")
    # rows that repeat a doc_id with its text are one set
    return made.join(asked, ["doc_id", "digest"]).groupBy("doc_id", "digest", "nid").agg(F.first("hashes").alias("hashes")).select("nid", "hashes")


def confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings, common: Callable[[np.ndarray, np.ndarray], tuple[float, float]] = in_common) -> DataFrame:
    """(a, b, likeness) of the pairs whose likeness by ``common`` reaches the threshold. A text b with many partners has them in parts of ``block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, mine = None, None
        for batch in batches:
            found = []
            for b, nid, hashes in zip(*[batch.column(c).to_pylist() for c in ("b", "nid")], batch.column("hashes")):
                theirs = np.frombuffer(hashes.as_buffer(), np.uint64)
                if nid == b:
                    centre, mine = b, theirs
                elif centre == b:
                    both, either = common(mine, theirs)
                    if both >= settings.similarity * either - 1e-9:
                        found.append((nid, b, both / either))
            a, b, likeness = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(likeness, pa.float64())], ["a", "b", "likeness"])

    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / settings.block).cast("int").alias("parts"))
    placed = settle(pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")), "ngram-cells")  # read twice
    rows = placed.select("b", "part", F.col("a").alias("nid")).unionByName(placed.select("b", "part", F.col("b").alias("nid")).distinct())
    cells = rows.join(sets, "nid").select("b", "part", "nid", "hashes").repartition("b", "part").sortWithinPartitions("b", "part", "nid")  # b is the least
    return cells.mapInArrow(run, "a bigint, b bigint, likeness double")


def dealt(rows: DataFrame, group: list[str], block: int) -> DataFrame:
    """``rows`` (group, nid, root, ...) of groups with several roots, once for each cell (group, i, j): the pairs of side i with side j, or within i
    where i = j. Every pair of different roots has its cell: texts of the group's largest root meet the others alone, those meet all."""
    roots = rows.groupBy(*group, "root").count().groupBy(*group)
    facts = roots.agg(F.sum("count").alias("n"), F.max(F.struct("count", "root")).alias("top")).filter("n > top.count")
    blocks_of = lambda n: F.ceil(n / block).cast("int")
    facts = facts.select(*group, F.col("top.root").alias("main"), blocks_of(F.col("n") - F.col("top.count")).alias("others"), blocks_of(F.col("top.count")).alias("own"))
    most, spread = F.col("root") == F.col("main"), F.xxhash64("nid")
    side = F.when(most, F.col("others") + F.pmod(spread, F.col("own"))).otherwise(F.pmod(spread, F.col("others"))).cast("int")
    meets = F.sequence(F.lit(0), F.when(most, F.col("others")).otherwise(F.col("others") + F.col("own")) - 1)
    placed = rows.join(facts, group).withColumn("side", side).withColumn("other", F.explode(meets))
    placed = placed.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("main", "others", "own", "other")
    return placed.repartition(*group, "i", "j").sortWithinPartitions(*group, "i", "j", "nid")


def _pairs_in_cells(cells: DataFrame, group: list[str], data: str, work: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b): what ``work`` finds in each cell from nids, roots, ``data`` as bytes, and the places of both sides, which are one where i = j."""
    names = [*group, "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nids, roots, sides, held = None, [], [], [], []

        def done() -> pa.RecordBatch:
            side = np.array(sides)
            left = np.flatnonzero(side == key[-2])
            a, b = work(np.array(nids), np.array(roots), held, left, left if key[-2] == key[-1] else np.flatnonzero(side == key[-1]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in names])
            columns = [batch.column(c).to_pylist() for c in ("nid", "root", "side")]
            for mine, nid, root, side, value in zip(keys, *columns, batch.column(data)):
                if key != mine:
                    if key is not None:
                        yield done()
                    key, nids, roots, sides, held = mine, [], [], [], []
                nids.append(nid), roots.append(root), sides.append(side), held.append(value.as_py())
        if key is not None:
            yield done()

    return cells.mapInArrow(run, "a bigint, b bigint")


def crowds(members: DataFrame, neighbours: int, settings: Settings) -> DataFrame:
    """(nid, crowd) of the texts with a likely pair of different roots in nodes of more members than ``neighbours`` let meet all. Such pairs are in
    one crowd. ``members`` has (nid, tree, label, sig, root)."""

    def hang(nids: np.ndarray, roots: np.ndarray, held: list[bytes], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sigs = np.frombuffer(b"".join(held), np.uint8).reshape(len(held), -1)
        every, within = np.arange(len(nids)), left is right
        least = every.copy()  # of what hangs together so far
        for a in left:
            far = right[(roots[right] != roots[a]) & ((right > a) if within else True)]
            near = far[np.count_nonzero(sigs[far] == sigs[a], axis=1) >= settings.loose * settings.values]
            if len(near):
                met = np.append(least[near], least[a])
                least[np.isin(least, met)] = met.min()
        tied = np.flatnonzero(least != every)
        return nids[tied], nids[least[tied]]

    rows = members.select("tree", F.shiftright("label", 12).alias("prefix"), "nid", "root", "sig")
    crowded = rows.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.min("root").alias("first"), F.max("root").alias("last")).filter(f"n > {neighbours + 1} and first <> last")
    rows = settle(rows.join(crowded.select("tree", "prefix"), ["tree", "prefix"]), "ngram-crowded")
    tied = _pairs_in_cells(dealt(rows, ["tree", "prefix"], settings.crowd), ["tree", "prefix"], "sig", hang)
    return components(tied).select(F.col("node").alias("nid"), F.col("root").alias("crowd"))


def linked_roots(held: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): roots with a link between texts of one crowd, from (crowd, nid, root, hashes); all pairs of different roots are verified."""

    def verify(nids: np.ndarray, roots: np.ndarray, held: list[bytes], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sets, within = [np.frombuffer(h, np.uint64) for h in held], left is right
        sizes = np.array([len(x) for x in sets])
        distinct, number = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.cumsum(sizes) - sizes
        right = right[sizes[right] > 0]
        found = [np.zeros((0, 2), np.int64)]
        if len(right):
            flags = np.zeros(len(distinct), bool)
            shingles = np.concatenate([number[begin[r] : begin[r] + sizes[r]] for r in right])
            at = np.cumsum(sizes[right]) - sizes[right]
            for a in left[sizes[left] > 0]:
                mine = number[begin[a] : begin[a] + sizes[a]]
                flags[mine] = True
                both = np.add.reduceat(flags[shingles].astype(np.int32), at)
                flags[mine] = False
                hit = (both >= settings.similarity * (sizes[a] + sizes[right] - both) - 1e-9) & (roots[right] != roots[a])
                to = np.unique(roots[right[hit & ((right > a) if within else True)]])
                found.append(np.stack([np.maximum(to, roots[a]), np.minimum(to, roots[a])], axis=1))
        a, b = np.unique(np.concatenate(found), axis=0).T
        return a, b

    return _pairs_in_cells(dealt(held, ["crowd"], settings.block), ["crowd"], "hashes", verify).distinct()


def frequent(texts: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The upper halves, sorted, of the hashes of at most ``last`` frequent shingles, and how often stretches of texts hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= settings.often
            return pa.RecordBatch.from_arrays([pa.array(values[many].astype(np.int64)), pa.array(counts[many])], ["shingle", "n"])

        for batch in blocks(batches, "text", 1 << 19):
            held.append((shingle_hashes(*text_bytes(batch.column("text")), settings.size)[0] >> np.uint64(32)).astype(np.uint32))
            if sum(len(x) for x in held) >= STRETCH:
                yield done()
                held = []
        if held:
            yield done()

    counts = texts.select("text").mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "shingle").limit(settings.last).collect()  # bounded
    hashes, n = np.array([r.shingle for r in rows], np.int64).astype(np.uint32), np.array([r.n for r in rows], np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def prefixes(texts: DataFrame, settings: Settings) -> DataFrame:
    """(shingle, key, size, place) of (key, text): the first shingles of each text in one order of all, so many that two texts at the threshold
    share one of them; ``size`` counts all shingles of the text, ``place`` from 0. Of a shingle's hash 40 bits go on: more can only meet by that."""
    late, weights = frequent(texts, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 19):
            hashes, owner = _distinct_shingles(batch.column("text"), settings)
            weight = np.zeros(len(hashes), np.int64)
            if len(late):
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(late, short), len(late) - 1)
                weight = np.where(late[at] == short, weights[at], 0)
            order = np.lexsort((hashes, weight, owner))
            sizes = np.bincount(owner, minlength=batch.num_rows)
            place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            least = np.ceil(settings.similarity * sizes - 1e-9).astype(np.int64)  # that two texts at the threshold share
            kept = place <= np.repeat(sizes - least, sizes)
            keys = batch.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array((hashes[order][kept] >> np.uint64(24)).view(np.int64)), pa.array(keys[owner[kept]]), pa.array(sizes[owner[kept]].astype(np.int32)), pa.array(place[kept].astype(np.int32))],
                ["shingle", "key", "size", "place"],
            )

    return texts.mapInArrow(run, "shingle bigint, key bigint, size int, place int")


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of many rows in which each group of equal ``names``, which are sorted, is whole: the last one waits for its end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < HAND:
            continue
        table = pa.Table.from_batches(held)
        differ = np.logical_or.reduce([x != x[-1] for x in (table.column(c).to_numpy() for c in names)])
        cut = int(np.flatnonzero(differ)[-1]) + 1 if differ.any() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _fitting(new: np.ndarray, who: np.ndarray, size: np.ndarray, place: np.ndarray, settings: Settings, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), a > b: the pairs of different ``who`` within groups that begin where ``new`` is set, whose sizes and places allow the threshold."""
    end = np.append(np.flatnonzero(new)[1:], len(new))[np.cumsum(new) - 1]
    found, x, step = [np.zeros((0, 2), np.int64)], np.arange(len(new)), 1
    while len(x := x[x + step < end[x]]):
        y = x + step
        step += 1
        most = np.minimum(size[x] - place[x], size[y] - place[y])  # in common, if this is the first such shingle
        ok = most >= settings.similarity / (1 + settings.similarity) * (size[x].astype(np.int64) + size[y]) - 1e-6
        ok &= (who[x] != who[y]) & allowed(x, y)
        a, b = who[x[ok]], who[y[ok]]
        found.append(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1))
    a, b = np.unique(np.concatenate(found), axis=0).T
    return a, b


def unmet(texts: DataFrame, known: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): all pairs of different roots and of no crowd in common that may reach the threshold, from (key, text) and (key, nid, root, crowd);
    crowd may be null. Shingles of at most ``crowd`` texts give their pairs where they lie, the texts of the others meet in cells.

    Where the shared shingles of two texts that come before a shingle end with the same one, the pair is given there already, and not again."""
    names = ["shingle", "nid", "root", "crowd", "size", "place", "before"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["shingle"]):
            few = table.filter(pa.compute.less_equal(table.column("n"), settings.crowd))
            shingle, nid, root, crowd, size, place, before = (few.column(c).to_numpy() for c in names)
            allowed = lambda x, y: (root[x] != root[y]) & (crowd[x] != crowd[y]) & ((before[x] != before[y]) | (before[x] < 0))
            a, b = _fitting(np.diff(shingle, prepend=shingle[:1] - 1) != 0, nid, size, place, settings, allowed)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.nulls(len(a), few.schema.field(c).type) for c in names]], ["a", "b", *names])
            many = table.filter(pa.compute.greater(table.column("n"), settings.crowd)).select(names)
            for c in ("b", "a"):
                many = many.add_column(0, c, pa.nulls(len(many), pa.int64()))
            yield from many.to_batches()

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["shingle", "i", "j"]):
            shingle, nid, root, crowd, size, place, before, i, j, side = (table.column(c).to_numpy() for c in [*names, "i", "j", "side"])
            new = np.ones(len(nid), bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            allowed = lambda x, y: (root[x] != root[y]) & (crowd[x] != crowd[y]) & ((before[x] != before[y]) | (before[x] < 0)) & ((i[x] == j[x]) | (side[x] != side[y]))
            a, b = _fitting(new, nid, size, place, settings, allowed)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    mine = Window.partitionBy("shingle")
    shared = prefixes(texts, settings).withColumns({"least": F.min("key").over(mine), "most": F.max("key").over(mine)}).filter("least <> most")
    shared = shared.select("shingle", "key", "size", "place").distinct()
    # a text without a crowd is its own, below all others
    known = known.withColumn("crowd", F.coalesce("crowd", -1 - F.col("nid")))
    earlier = F.lag("shingle", 1, -1).over(Window.partitionBy("key", "nid").orderBy("place"))
    rows = shared.join(known, "key").withColumn("before", earlier).select(*names)
    rows = rows.withColumns({"least": F.min("root").over(mine), "most": F.max("root").over(mine), "n": F.count("*").over(mine)}).filter("least <> most")
    kinds = ", ".join(f"{c} {'int' if c in ('size', 'place') else 'bigint'}" for c in names)
    found = settle(rows.select(*names, "n").sortWithinPartitions("shingle").mapInArrow(near, f"a bigint, b bigint, {kinds}"), "ngram-prefixes")
    cells = dealt(settle(found.filter("a is null").select(*names), "ngram-frequent"), ["shingle"], settings.crowd).select(*names, "i", "j", "side")
    return found.filter("a is not null").select("a", "b").unionByName(cells.mapInArrow(far, "a bigint, b bigint")).distinct()


def counted(cells: DataFrame, settings: Settings) -> DataFrame:
    """(nid, links) for each text of each cell: its links in the cell.

    ``cells`` is grouped by (cell, i, j) and sorted by nid; side is the block of a row: pairs of i with j, or within i where i = j."""

    def links_of(sets: list[np.ndarray], side: np.ndarray, i: int, j: int) -> np.ndarray:
        sizes = np.array([len(x) for x in sets])
        distinct, number = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.cumsum(sizes) - sizes
        links = np.zeros(len(sets), np.int64)
        flags = np.zeros(len(distinct) + 1, bool)
        left = np.flatnonzero(side == i)
        right = left if i == j else np.flatnonzero(side == j)
        right = right[sizes[right] > 0]
        if not len(right):
            return links
        held = np.concatenate([number[begin[r] : begin[r] + sizes[r]] for r in right])
        at = np.cumsum(sizes[right]) - sizes[right]
        for a in left[sizes[left] > 0]:
            mine = number[begin[a] : begin[a] + sizes[a]]
            flags[mine] = True
            both = np.add.reduceat(flags[held].astype(np.int32), at)
            flags[mine] = False
            hit = both >= settings.similarity * (sizes[a] + sizes[right] - both) - 1e-9
            found = right[hit & ((right > a) if i == j else True)]
            links[a] += len(found)
            links[found] += 1
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets, side, nids = None, [], [], []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(nids, pa.int64()), pa.array(links_of(sets, np.array(side), key[1], key[2]))], ["nid", "links"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cell", "i", "j", "side", "nid")]
            for c, i, j, s, nid, hashes in zip(*columns, batch.column("hashes")):
                if key != (c, i, j):
                    if key is not None:
                        yield done()
                    key, sets, side, nids = (c, i, j), [], [], []
                sets.append(np.frombuffer(hashes.as_py(), np.uint64)), side.append(s), nids.append(nid)
        if key is not None:
            yield done()

    return cells.mapInArrow(run, "nid bigint, links bigint")


def digest_of(text: Column) -> Column:
    """By this texts are equal; null texts are empty ones."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", digest_of(F.col("text")))


def linked(classes: DataFrame, texts: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the texts with links, and the shingle sets (nid, hashes), from (nid, doc_id, digest, sig, labels) and the texts."""
    members = settle(trie_members(classes, settings), "trie-members")
    # the texts that meet another one in some node; the others have no links
    sigs = settle(classes.select("nid", "doc_id", "digest", "sig").join(members.select("nid").distinct(), "nid", "left_semi"), "trie-texts")
    sets = settle(of_texts(texts, sigs.select("nid", "doc_id", "digest"), shingle_sets, settings), "ngram-sets")
    known = settle(members.join(sigs.select("nid", "sig"), "nid").withColumn("root", F.col("nid")), "ngram-nodes")
    long = settle(ties(known, [0], 1, settings), "ngram-long")
    both = long.select(F.col("a").alias("u"), F.col("b").alias("v"), "estimate").unionByName(long.select(F.col("b").alias("u"), F.col("a").alias("v"), "estimate"))
    best = both.groupBy("u").agg(F.max_by("v", F.struct("estimate", -F.col("v"))).alias("v"))
    best = best.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    first = settle(confirmed(best, sets, settings), "ngram-first")
    roots = settle(components(first.select("a", "b")), "ngram-roots")
    named = roots.select(F.col("node").alias("nid"), F.col("root").alias("class"))
    classed = known.drop("root").join(named, "nid", "left").withColumn("root", F.coalesce("class", "nid")).drop("class")
    short = ties(classed, [12, 8, 4], settings.beside, settings).select("a", "b")
    # what the longest prefix has proposed between classes is verified too
    left = long.join(named.select(F.col("nid").alias("a"), F.col("class").alias("class_a")), "a", "left").join(named.select(F.col("nid").alias("b"), F.col("class").alias("class_b")), "b", "left")
    left = left.filter(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select("a", "b")
    rest = settle(short.unionByName(left).distinct(), "ngram-short")
    more = confirmed(rest, sets, settings)
    edges = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more.select("a", "b"))
    joined = settle(components(edges), "ngram-joined")
    # in nodes where not all have met, all pairs that are of different classes still
    named = joined.select(F.col("node").alias("nid"), F.col("root").alias("class"))
    classed = known.drop("root").join(named, "nid", "left").withColumn("root", F.coalesce("class", "nid")).drop("class")
    crowd = settle(crowds(classed, settings.beside, settings), "ngram-crowd")
    held = crowd.join(named, "nid", "left").select("crowd", "nid", F.coalesce("class", "nid").alias("root")).join(sets, "nid")
    late = linked_roots(settle(held, "ngram-crowds"), settings)
    edges = joined.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late)
    met = settle(components(edges), "ngram-met")
    # pairs that meet in no node, or are estimated too low
    key = F.xxhash64("digest").alias("key")
    known = classes.select("nid", key).join(met.select(F.col("node").alias("nid"), "root"), "nid", "left").join(crowd, "nid", "left")
    known = settle(known.select("key", "nid", F.coalesce("root", "nid").alias("root"), "crowd"), "ngram-known")
    pairs = settle(unmet(texts.filter("doc_id is not null").select(key, "text"), known, settings), "ngram-unmet")
    ids = classes.select("nid", "doc_id", "digest")
    ends = lambda some: some.select(F.col("a").alias("nid")).unionByName(some.select(F.col("b").alias("nid"))).distinct()
    # most of them share but a passage: parities of cells tell
    asked = settle(ids.join(ends(pairs), "nid"), "ngram-asked")
    pairs = settle(confirmed(pairs, of_texts(texts, asked, parities, settings), settings, most_in_common).select("a", "b"), "ngram-near")
    fresh = settle(asked.join(ends(pairs), "nid", "left_semi").join(sigs.select("nid"), "nid", "left_anti"), "ngram-fresh")
    sets = sets.unionByName(settle(of_texts(texts, fresh, shingle_sets, settings), "ngram-more-sets"))
    last = confirmed(pairs, sets, settings)
    edges = met.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(last.select("a", "b"))
    return settle(components(edges), "ngram-linked"), sets


def classes_of(texts: DataFrame, settings: Settings, count_links: bool = True) -> DataFrame:
    """(digest, text_id, class_id, class_digest, n_links, n_copies) for each distinct text of (doc_id, text, digest) that has a doc_id; the
    text of class_digest is the one that stands for its class: of its texts with the least doc_id, that of the least digest."""
    signed = signatures(texts.filter("doc_id is not null"), settings)
    classes = signed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"), F.first("labels").alias("labels"))
    classes = settle(classes.withColumn("nid", F.monotonically_increasing_id()), "ngram-classes")
    found, sets = linked(classes, texts, settings)
    named = classes.select("nid", F.col("doc_id").alias("rid"), "digest", "n_copies").join(found.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    if count_links:
        sizes = found.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / settings.block)).cast("int").alias("blocks"))
        held = found.join(sizes, "root").select(F.col("node").alias("nid"), F.col("root").alias("cell"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("side")).join(sets, "nid")
        # a block meets itself and every other one: cells (i, j) with i <= j
        met = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "nid", "hashes")
        cells = settle(counted(met.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "nid"), settings), "ngram-counted")
        named = named.join(cells.groupBy("nid").agg(F.sum("links").alias("n_links")), "nid", "left")
    else:
        named = named.withColumn("n_links", F.lit(None).cast("bigint"))
    least = named.groupBy("root").agg(F.min("rid").alias("class_id"), F.min_by("digest", F.struct("rid", "digest")).alias("class_digest"))
    return named.join(least, "root").select("digest", F.col("rid").alias("text_id"), "class_id", "class_digest", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")


def firsts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, digest) of the text that stands for each class."""
    return classes_of(texts_of(docs), settings, False).filter("digest = class_digest").select(F.col("class_id").alias("doc_id"), "digest")


def join(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, text_id, n_links, n_copies) for each row of (doc_id, text): class_id the least doc_id of its class of linked
    texts, text_id the least doc_id of its equal texts, n_links how many other texts it is linked with, n_copies rows of its text."""
    texts = texts_of(docs)
    per_text = classes_of(texts, settings)
    has = F.col("doc_id").isNotNull()
    return texts.select("doc_id", "digest").join(per_text, "digest", "left").select(
        "doc_id", F.when(has, F.col("class_id")).alias("class_id"), F.when(has, F.col("text_id")).alias("text_id"),
        F.when(has, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(has, F.col("n_copies")).otherwise(1).cast("long").alias("n_copies"),
    )
