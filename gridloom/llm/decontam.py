"""Benchmark decontamination: suffix arrays over shards of the training text, searched with every suffix of the benchmark.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters beyond ASCII. A window is ``Settings.window``
consecutive words of an item; an item of fewer words, but not none, is one window.

1. A task cuts its texts into shards of about ``Settings.shard`` bytes. All suffixes of a shard are sorted by their first four words (16
   bits of each word's hash): the shard's suffix array. No suffix runs over the end of its text.
2. Every distinct suffix of the benchmark that begins a window is looked up by two binary searches. Only the intervals that some suffix
   meets are sorted deeper, word by word and now by whole 64-bit hashes, and searched again, down to the longest match.
3. An interval at the depth of a window holds all occurrences of it: their words are hit. What is left at greater depths gives each text's
   longest verbatim match and its places in the text and in the item.

A text longer than a shard is read in pieces that overlap by the longest item, so no match is lost at an edge and memory stays bounded.
The benchmark goes to the tasks in chunks of at most ``Settings.chunk`` words (or one longer item); more than one chunk means more than
one pass over the texts, whose results are joined. Documents are never shuffled.

Null and empty texts have no words and no hits. Ties: of equally long matches the first place in the text is named, then the first in the
benchmark's order. Rows that repeat a doc_id, or have none, each give a row. Items that share an id count once; one without id marks words
but isn't listed. Other columns are not looked at (``scan``) or kept (``clean``). Empty tables give no rows, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import blocks, settle, text_bytes, word_hashes


@dataclass(frozen=True)
class Settings:
    window: int = 10
    shard: int = 1 << 20
    chunk: int = 1 << 22


#: Words of the first sort key, and bits of each.
HEAD, BITS = 4, 16
_LETTERS = np.full(256, 32, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _LETTERS[_low:_high] = np.arange(_low, _high)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)


@dataclass(frozen=True)
class Suffixes:
    """The suffixes of a chunk of the benchmark that begin a window: ``words`` of all items behind one another, and of each suffix its
    place there, its item, its length and the length of its window. ``names`` are the items' ids."""

    words: np.ndarray
    start: np.ndarray
    item: np.ndarray
    length: np.ndarray
    need: np.ndarray
    item_start: np.ndarray
    names: list[str | None]
    vocabulary: np.ndarray
    ids: np.ndarray
    longest: int


def suffixes_of(items: list[tuple[str | None, np.ndarray]], window: int) -> Suffixes:
    words = np.concatenate([w for _, w in items]) if items else np.zeros(0, np.uint64)
    sizes = np.array([len(w) for _, w in items], np.int64)
    begin = np.cumsum(sizes) - sizes
    item = np.repeat(np.arange(len(items)), sizes)
    start = np.arange(len(words))
    length = begin[item] + sizes[item] - start
    keep = (length >= window) | (start == begin[item])
    vocabulary, ids = np.unique(words, return_inverse=True)
    return Suffixes(words, start[keep], item[keep], length[keep], np.minimum(length, window)[keep], begin, [n for n, _ in items], vocabulary, ids.reshape(-1), int(sizes.max(initial=0)))


def _heads(words: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The sort key of the suffix at each word; ``left`` are the words from there to the end of its text. 0 stands for the end."""
    code = np.maximum(words >> np.uint64(64 - BITS), np.uint64(1))
    key = np.zeros(len(words), np.uint64)
    for k in range(HEAD):
        part = np.zeros(len(words), np.uint64)
        part[: max(len(words) - k, 0)] = code[k:]
        part[left <= k] = 0
        key |= part << np.uint64(BITS * (HEAD - 1 - k))
    return key


@dataclass
class Found:
    """Of one shard: the hit words, pairs (text, item), and each text's longest match with its place and the suffix that it is of."""

    hit: np.ndarray
    pairs: np.ndarray
    longest: np.ndarray
    place: np.ndarray
    suffix: np.ndarray


def _within(lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the intervals [low, high), and the number of the interval of each."""
    sizes = highs - lows
    which = np.repeat(np.arange(len(lows)), sizes)
    return lows[which] + np.arange(len(which)) - (np.cumsum(sizes) - sizes)[which], which


def search(words: np.ndarray, owner: np.ndarray, n: int, tests: Suffixes) -> Found:
    """Look up all ``tests`` in the suffix array of ``words``, of which each belongs to one of ``n`` texts."""
    out = Found(np.zeros(len(words), bool), np.zeros((0, 2), np.int64), np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1))
    if not len(words) or not len(tests.start):
        return out
    ends = np.cumsum(np.bincount(owner, minlength=n))
    left = ends[owner] - np.arange(len(words))
    key = _heads(words, left)
    order = np.argsort(key)
    key = key[order]
    own_left = np.zeros(len(tests.words), np.int64)
    own_left[tests.start] = tests.length
    low_key, which = np.unique(_heads(tests.words, own_left)[tests.start], return_inverse=True)
    # a suffix of fewer words than the key has meets all that begin with them
    high_key = low_key.copy()
    for k in range(1, HEAD):
        short = low_key & np.uint64((1 << BITS * k) - 1) == 0
        high_key[short] |= np.uint64((1 << BITS * k) - 1)
    lows, highs = np.searchsorted(key, low_key, "left"), np.searchsorted(key, high_key, "right")
    at, group = _within(lows, highs)
    at = order[at]  # the training suffixes that go on, and the test suffixes: each in a group of those that agree so far
    test, of = np.arange(len(tests.start)), which.reshape(-1)
    marks = np.zeros(len(words) + 1, np.int32)
    pairs = []
    for depth in range(tests.longest + 1):
        if not len(at):
            break
        # windows that end here, and the longest matches so far
        done = tests.need[test] == depth
        if done.any():
            over = np.isin(group, of[done])
            np.add.at(marks, at[over], 1)
            np.subtract.at(marks, at[over] + depth, 1)
            pairs.append(_pairs(owner[at[over]], group[over], of[done], tests.item[test[done]]))
        whole = np.zeros(max(group.max(), of.max()) + 1, np.int64) - 1
        long_enough = tests.need[test] <= depth
        whole[of[long_enough][::-1]] = test[long_enough][::-1]
        known = at[whole[group] >= 0]
        if len(known):
            first = np.lexsort((known, owner[known]))
            texts, lead = np.unique(owner[known][first], return_index=True)
            out.longest[texts], out.place[texts], out.suffix[texts] = depth, known[first][lead], whole[group[whole[group] >= 0]][first][lead]
        # one word deeper: sort the intervals by it and search them for the next word of each test suffix
        going = tests.length[test] > depth
        test, of = test[going], of[going]
        inside = left[at] > depth
        at, group = at[inside], group[inside]
        if not len(test) or not len(at):
            break
        word = words[at + depth]
        number = np.searchsorted(tests.vocabulary, word)
        number[number == len(tests.vocabulary)] = 0
        same = tests.vocabulary[number] == word
        at, key = at[same], group[same].astype(np.int64) << 32 | number[same]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        wanted, of = np.unique(of.astype(np.int64) << 32 | tests.ids[tests.start[test] + depth], return_inverse=True)
        of = of.reshape(-1)
        lows, highs = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
        stay = highs > lows
        place, group = _within(lows[stay], highs[stay])
        at, alive = at[place], stay[of]
        test, of = test[alive], (np.cumsum(stay) - 1)[of[alive]]
    out.hit = np.cumsum(marks)[:-1] > 0
    if pairs:
        out.pairs = np.unique(np.concatenate(pairs), axis=0)
    return out


def _pairs(text: np.ndarray, group: np.ndarray, of: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Distinct (text, item) with a common group, from (text, group) and (of, item)."""
    left = np.unique(np.stack([group, text], 1), axis=0)
    right = np.unique(np.stack([of, item], 1), axis=0)
    place, which = _within(np.searchsorted(right[:, 0], left[:, 0], "left"), np.searchsorted(right[:, 0], left[:, 0], "right"))
    return np.stack([left[which, 1], right[place, 1]], 1)


def _pieces(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """``data`` in parts of about ``size`` bytes, none of which ends inside a word."""
    begin = 0
    while begin < len(data):
        end = min(begin + size, len(data))
        while end < len(data):
            gap = np.flatnonzero(data[end : end + size] == 32)
            end += int(gap[0]) if len(gap) else min(size, len(data) - end)
            if len(gap):
                break
        yield data[begin:end]
        begin = end


def search_long(data: np.ndarray, tests: Suffixes, size: int) -> tuple[Found, int]:
    """As ``search`` over one text's bytes, piece by piece; with the number of words."""
    keep = max(tests.longest - 1, 0)
    total, hits, pairs, best = 0, [], [], (0, -1, -1)
    tail, tail_hit = np.zeros(0, np.uint64), np.zeros(0, bool)
    for piece in _pieces(data, size):
        words = np.concatenate([tail, word_hashes(piece, np.array([0, len(piece)]))[0]])
        found = search(words, np.zeros(len(words), np.int64), 1, tests)
        found.hit[: len(tail)] |= tail_hit
        base = total - len(tail)
        total = base + len(words)
        if found.longest[0] > best[0]:
            best = (int(found.longest[0]), int(found.place[0]) + base, int(found.suffix[0]))
        pairs.append(found.pairs)
        cut = max(len(words) - keep, 0)
        hits.append(found.hit[:cut])
        tail, tail_hit = words[cut:], found.hit[cut:]
    hit = np.concatenate([*hits, tail_hit])
    pair = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    return Found(hit, pair, *(np.array([x]) for x in best)), total


def _found(batch: pa.RecordBatch, text: str, tests: Suffixes, size: int) -> tuple[Found, np.ndarray]:
    """What a batch of one shard holds, and the number of words of each text."""
    raw, offsets = text_bytes(pc.fill_null(batch.column(text), ""))
    data = _LETTERS[raw]
    if batch.num_rows == 1 and len(data) > 2 * size:
        found, total = search_long(data, tests, size)
        return found, np.array([total])
    words, owner = word_hashes(data, offsets)
    return search(words, owner, batch.num_rows, tests), np.bincount(owner, minlength=batch.num_rows)


def item_words(items: DataFrame) -> DataFrame:
    """(item, n, words) of (item_id, text) for items with words: their word hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            raw, offsets = text_bytes(batch.column("text"))
            words, owner = word_hashes(_LETTERS[raw], offsets)
            at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(np.diff(at), pa.int64()), pa.array([words[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], ["item", "n", "words"])

    named = items.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    return named.mapInArrow(run, "item string, n bigint, words binary").filter("n > 0")


def chunks(items: DataFrame, settings: Settings) -> Iterator[Suffixes]:
    """The benchmark in chunks of bounded size, read one partition at a time; one empty chunk where there are no words."""
    held, n, any_chunk = [], 0, False
    for row in settle(item_words(items), "benchmark-words").toLocalIterator():
        if held and n + row.n > settings.chunk:
            yield suffixes_of(held, settings.window)
            held, n, any_chunk = [], 0, True
        held.append((row.item, np.frombuffer(row.words, np.uint64)))
        n += row.n
    if held or not any_chunk:
        yield suffixes_of(held, settings.window)


ROW = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, longest bigint, longest_at bigint, longest_item string, longest_item_at bigint, spans array<struct<first:bigint,last:bigint>>"


def _scan(docs: DataFrame, held: Broadcast, settings: Settings) -> DataFrame:
    """``ROW`` for each row of (doc_id, text), by one chunk of the benchmark. Spans are runs of hit words, both ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = held.value
        names = np.array(tests.names, object)
        for batch in blocks(batches, "text", settings.shard):
            found, counts = _found(batch, "text", tests, settings.shard)
            begin = np.cumsum(counts) - counts
            owner = np.repeat(np.arange(batch.num_rows), counts)
            edge = np.ones(len(owner), bool)
            edge[1:] = owner[1:] != owner[:-1]
            before, after = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
            before[1:], after[:-1] = found.hit[:-1] & ~edge[1:], found.hit[1:] & ~edge[1:]
            first, last = np.flatnonzero(found.hit & ~before), np.flatnonzero(found.hit & ~after)
            spans = pa.StructArray.from_arrays([pa.array(first - begin[owner[first]]), pa.array(last - begin[owner[last]])], ["first", "last"])
            at = np.searchsorted(owner[first], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for text, item in {(t, names[i]) for t, i in found.pairs.tolist()}:
                if item is not None:
                    lists[text].append(item)
            some = found.longest > 0
            item = tests.item[found.suffix] if len(tests.item) else np.zeros(batch.num_rows, np.int64)
            place = np.where(some, found.place - begin, 0)
            item_at = (tests.start[found.suffix] - tests.item_start[item]) if len(tests.item) else item
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(np.bincount(owner[found.hit], minlength=batch.num_rows).astype(np.int64)),
                    pa.array([sorted(x) for x in lists], pa.list_(pa.string())), pa.array(found.longest), pa.array(place, pa.int64(), mask=~some),
                    pa.array([names[i] if s else None for i, s in zip(item, some)], pa.string()), pa.array(item_at, pa.int64(), mask=~some), pa.ListArray.from_arrays(at, spans),
                ],
                ["doc_id", "n_words", "n_hit", "items", "longest", "longest_at", "longest_item", "longest_item_at", "spans"],
            )

    return docs.mapInArrow(run, ROW)


def _merged(parts: DataFrame) -> DataFrame:
    """One row for each ``row`` of the passes: items and spans united, the longest match of all."""
    ordered = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.max_by(F.struct("longest", "longest_at", "longest_item", "longest_item_at"), F.struct("longest", -F.col("longest_at"), -F.col("pass"))).alias("best"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    # spans in order: one that begins by the end of the last one or right behind it lengthens it
    joined = F.aggregate(
        "spans", F.array().cast("array<struct<first:bigint,last:bigint>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["last"] >= s["first"] - 1),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.get(done, F.size(done) - 1)["first"].alias("first"), F.greatest(F.get(done, F.size(done) - 1)["last"], s["last"]).alias("last")))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    rows = ordered.withColumn("spans", joined)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.array_sort("items").alias("items"), "best.*", "spans")


def scan(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``ROW`` for each row of ``docs`` (doc_id, text): words, hit words, the ids of the items of ``items`` (item_id, text) with an occurring
    window, the longest verbatim match of a window or more with its places, and the spans of hit words."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = chunks(items, settings)
    one, two = next(parts), next(parts, None)
    if two is None:
        return _scan(texts, sc.broadcast(one), settings)
    numbered = settle(texts.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
    known, passes = numbered.select("row", "doc_id"), []
    for k, tests in enumerate([one, two]):
        passes.append(_pass(numbered, sc.broadcast(tests), settings, k))
    for k, tests in enumerate(parts, 2):
        passes.append(_pass(numbered, sc.broadcast(tests), settings, k))
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    return _merged(every.join(known.withColumnRenamed("doc_id", "own"), "row").withColumn("doc_id", F.col("own")))


def _pass(numbered: DataFrame, held: Broadcast, settings: Settings, k: int) -> DataFrame:
    """The results of one chunk, by ``row``; written, so that no two chunks are held at once."""
    found = settle(_scan(numbered.select(F.col("row").alias("doc_id"), "text"), held, settings).withColumn("pass", F.lit(k)), f"benchmark-pass-{k}")
    held.unpersist()
    return found.withColumn("row", F.col("doc_id"))


def clean(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit word, with all their columns; each chunk of the benchmark takes out its own."""
    sc = docs.sparkSession.sparkContext
    for tests in chunks(items, settings):
        held = sc.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches, text, settings.shard):
                found, counts = _found(batch, text, held.value, settings.shard)
                hits = np.bincount(np.repeat(np.arange(batch.num_rows), counts)[found.hit], minlength=batch.num_rows)
                yield batch.filter(pa.array(hits == 0))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = scan(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "longest", "longest_at", "longest_item", "longest_item_at",
    )
