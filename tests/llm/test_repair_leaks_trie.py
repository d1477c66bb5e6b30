"""Conversation repair, benchmark decontamination and the prefix trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontam, euler, repair, trie

TURNS = "conv_id long, turn long, role string, text string"


def some_turns(seed, convs=150, long=300):
    pick = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(pick.choice([0, 1, 2, 5, 9, 30, long if c < 3 else 3])):
            texts = ["a.", "b", "", " \n", "c!", "d?  ", "e. ", None, f"x{t}.", f"y{t}.", f"z{t}é"]
            rows.append((c if c else None, pick.choice([t, t, t, None, t + 2]), pick.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), pick.choice(texts)))
    pick.shuffle(rows)
    return rows


# ---------------------------------------------------------------- repair


def repaired_by_force(rows):
    convs, ids = defaultdict(list), set()
    for c, t, r, x in rows:
        ids.add(c)
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            x, r = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x, "user" if kind == 4 else r
            convs[c] += [(t is not None, t or 0, r, x)] * (2 if kind == 3 else 1)
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    out = {}
    for c in ids:
        rows, seen, faults = sorted(convs[c]), set(), []
        for _, _, r, x in rows:
            bare = x.strip(" \t\n\x0b\x0c\r")
            faults.append("B" if not bare else "D" if (r, x) in seen else "T" if bare[-1] not in ".!?" else "-")
            seen.add((r, x))
        turns = [t for known, t, _, _ in rows if known]

        def better(ways, state, way):
            if state not in ways or way[:2] < ways[state][:2]:
                ways[state] = way

        def with_insertions(ways):
            for _ in range(3):
                for state, (cost, audit, got) in list(ways.items()):
                    better(ways, after[state], (cost + 3, audit + "I", [*got, f"{name[after[state]]}:"]))
            return ways

        ways = with_insertions({"": (0, "", [])})
        for (_, _, r, x), fault in zip(rows, faults):
            then = {}
            for state, (cost, audit, got) in ways.items():
                better(then, state, (cost + 4, audit + "D", got))
                if fault not in ("B", "D"):
                    more = 3 if fault == "T" else 0
                    if r[:1] == after[state] or r[:1] == "s" and state == "":
                        better(then, r[:1], (cost + more, audit + "K", [*got, f"{r}:{x}"]))
                    better(then, after[state], (cost + 3 + more, audit + "R", [*got, f"{name[after[state]]}:{x}"]))
            ways = with_insertions(then)
        cost, audit, got = min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *(faults.count(f) for f in "BDT"), illegal, cost, audit, hashlib.sha256("\n".join(got).encode()).hexdigest())
    return out


@pytest.mark.parametrize("bits", [8, 1])
def test_repair_is_the_cheapest_there_is(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    rows = some_turns(bits)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS + ", at string, seg int").repartition(5)
    assert {r[0]: tuple(r)[1:] for r in repair.digest(df).collect()} == repaired_by_force(rows)


def test_repair_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert {r[0]: tuple(r)[1:] for r in repair.digest(df).collect()} == repaired_by_force([tuple(r) for r in df.collect()])


def test_repaired_rows_read_by_the_grammar(spark):
    df = spark.createDataFrame(some_turns(3), TURNS)
    got = defaultdict(str)
    for r in repair.repaired(df).orderBy("conv_id", "seg", "step").collect():
        got[r.conv_id] += r.role[:1]
    assert got and all(re.fullmatch("s?(ua)+", s) for s in got.values())


def test_repair_without_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repair.digest(empty).count() == 0 and repair.edits(empty).count() == 0
    # the only row is dropped: 0 of crc32("29:0") % 20
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = repair.digest(spark.createDataFrame([(gone, 0, "user", "a")], TURNS)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_long_conversation_is_not_one_segment(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(3000)]
    df = spark.createDataFrame(rows, TURNS).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        facts = repair.laid_out(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert facts.groupBy("seg").count().agg(F.max("count")).first()[0] <= 256
    assert facts.select(F.floor(F.col("at") / (1 << 33))).distinct().count() > 1
    assert {r[0]: tuple(r)[1:] for r in repair.digest(df).collect()} == repaired_by_force(rows)


# ---------------------------------------------------------------- decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def leaks_by_force(docs, items, size=10):
    windows = defaultdict(set)
    item_words = [(i, words_of(t)) for i, t in items]
    for i, words in item_words:
        for k in range(max(1, len(words) - size + 1) if words else 0):
            windows[tuple(words[k : k + size])].add(None if i is None else str(i))
    out = []
    for d, text in docs:
        words, hit, ids, longest = words_of(text), set(), set(), 0
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if found := windows.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= found
        out.append((d, len(words), len(hit), sorted(ids - {None})))
    return out


def scanned(df):
    return [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in df.collect()]


def hostile_texts(spark):
    pick = random.Random(11)
    vocabulary = ["the", "of", "la", "Café", "x1", "日本", "a", "end"]
    items = [(k, " ".join(pick.choice(vocabulary) for _ in range(pick.choice([0, 1, 2, 3, 5, 9, 10, 11, 25])))) for k in range(30)]
    items += [(3, "the the the"), (None, "only without an id stands here"), (50, "la " * 40), (51, None), (52, "...!"), (53, items[4][1])]
    docs = [(None, None), (1, ""), (2, "LA," * 200), (3, "Only without an ID stands here"), (3, items[8][1] + " " + items[9][1])]
    for d in range(60):
        parts = [pick.choice([" ".join(pick.choice(vocabulary) for _ in range(40)), pick.choice(items)[1] or "", "word"]) for _ in range(pick.choice([1, 3, 8]))]
        docs.append((d + 10, "-".join(parts)))
    docs.append((99, " ".join(pick.choice(["zz", "the", items[7][1] or "", "la la la la la la la la la la"]) for _ in range(4000))))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), docs, items


@pytest.mark.parametrize("settings", [decontam.Settings(), decontam.Settings(shard=400), decontam.Settings(chunk=60, shard=900)], ids=["one", "pieces", "chunks"])
def test_leaks_are_those_of_all_windows(spark, settings):
    docs, items, rows, item_rows = hostile_texts(spark)
    want = leaks_by_force(rows, item_rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(scanned(decontam.scan(docs, items, settings)), key=key) == sorted(want, key=key)
    extra = docs.withColumn("words", F.lit(1)).withColumn("row", F.lit("x"))
    kept = decontam.clean(extra, items, settings)
    assert kept.columns == extra.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((w[0] is None, w[0] or 0) for w in want if not w[2])


def test_leaks_of_the_table(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = leaks_by_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted(scanned(decontam.scan(docs, items))) == sorted(want) and any(w[2] for w in want)
    got = {r.doc_id: (r.n_items, r.items_sha256, r.contaminated) for r in decontam.digest(docs, items).collect()}
    assert got == {d: (len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), n > 0) for d, _, n, i in want}


def test_longest_match_and_places(spark):
    line = " ".join(f"w{k}" for k in range(40))
    items = spark.createDataFrame([(1, line), (2, " ".join(f"v{k}" for k in range(12)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a b c {' '.join(line.split()[5:30])} d " + " ".join(f"v{k}" for k in range(11))), (2, " ".join(line.split()[:9]))], "doc_id long, text string")
    for settings in (decontam.Settings(), decontam.Settings(shard=40), decontam.Settings(chunk=20)):
        got = {r.doc_id: r for r in decontam.scan(docs, items, settings).collect()}
        assert (got[1].longest, got[1].longest_at, got[1].longest_item, got[1].longest_item_at) == (25, 3, "1", 5)
        assert [tuple(s) for s in got[1].spans] == [(3, 27), (29, 39)] and (got[2].longest, got[2].n_hit, got[2].longest_at) == (0, 0, None)


def test_leaks_of_empty_tables(spark):
    docs, items, rows, _ = hostile_texts(spark)
    assert decontam.scan(docs.limit(0), items).count() == 0
    assert decontam.scan(docs, items.limit(0)).filter("n_hit = 0").count() == len(rows)


# ---------------------------------------------------------------- trie


def trie_by_force(rows, tie):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, tie(r or "", x or ""), r or "", x or ""))
    own = {c: [turn[3:] for turn in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[c][h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(built[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out[min(members[node]), len(node)] = (parent, len(members[node]), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
    return out


def by_md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def nodes_as_dict(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


@pytest.mark.parametrize("small", [euler.SMALL, 3])
def test_trie_is_that_of_all_prefixes(spark, small):
    pick = random.Random(small)
    rows = []
    for c in [*range(-12, 60), 1000, 10**12]:
        for t in range(pick.choice([1, 1, 2, 4, 8, 12])):
            rows.append((c, pick.choice([t, t, None]), pick.choice(["user", "user", None]), pick.choice(["a", "b", "éé", None])))
    rows += [(None, 0, "user", "a"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], TURNS + ", depth int, place int").repartition(4)
    assert nodes_as_dict(trie.digest(df, small, 10 if small == 3 else euler.HAND)) == trie_by_force(rows, by_md5)


def test_trie_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert nodes_as_dict(trie.digest(df)) == trie_by_force([tuple(r) for r in df.collect()], by_md5)
    assert trie.digest(df.limit(0)).count() == 0


def test_trie_of_one_long_conversation_and_many_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(trie, "DEPTHS", 16)
    monkeypatch.setattr(trie, "FANOUT", 8)
    monkeypatch.setattr(trie, "PIECE", 5)
    rows = [(5, t, "user", f"t{t % 7}") for t in range(400)] + [(c, 0, "user", "same") for c in range(100, 180)]
    df = spark.createDataFrame(rows, TURNS)
    assert nodes_as_dict(trie.digest(df, 4, 16)) == trie_by_force(rows, by_md5)


def test_turns_of_nodes(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, None, "b"), (2, 0, "user", "a")], TURNS)
    turns = trie.turns_of(df).withColumn("depth", F.col("place") + 1)
    nodes = trie.with_last_turns(trie.trie(turns, df.select("conv_id").distinct()), df)
    assert {(r.conv_id, r.depth, r.role, r.text, r.n_convs) for r in nodes.collect()} == {(1, 0, None, None, 2), (1, 1, "user", "a", 2), (1, 2, "", "b", 1)}


def test_list_ranks(spark):
    order = np.random.default_rng(1).permutation(500)
    rows = [(int(a), int(b), 1, int(a) // 7) for a, b in zip(order, order[1:])] + [(int(order[-1]), None, 1, 0)]
    placed = euler.rank(spark.createDataFrame(rows, "arc long, next long, length long, block long"), ["block"], 20, 50)
    assert {r.arc: r.pos for r in placed.collect()} == {int(a): k for k, a in enumerate(order)}
    sums = euler.running(spark.range(100).select(F.col("id").alias("pos"), F.lit(2).alias("v")), ["v"], 7)
    assert {r.pos: r.v for r in sums.collect()} == {k: 2 * k + 2 for k in range(100)}
