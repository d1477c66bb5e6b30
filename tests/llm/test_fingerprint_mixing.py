"""Fingerprints and mixing against plain Python."""

import hashlib
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import fingerprint, mixing

DOCS = "doc_id long, text string, sketch string, head string"


def shingles(text, size=5):
    w = text.split()
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(docs):
    """{doc_id: (edited text, next text)} by the contract."""
    order = sorted(docs, reverse=True)
    out = {}
    for k, d in enumerate(order):
        after = docs[order[(k + 1) % len(order)]]
        m = len(docs[d]) // 3
        out[d] = docs[d][: len(docs[d]) - m] + after[:m], after
    return out


def check(rows, docs, tolerance):
    want = edited(docs)
    assert len(rows) == len(docs)
    for r in rows:
        text, after = want[r.doc_id]
        assert r.n_chars == len(docs[r.doc_id])
        assert r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert abs(r.near_edited - likeness(shingles(docs[r.doc_id]), shingles(text))) <= tolerance
        assert abs(r.near_next - likeness(shingles(docs[r.doc_id]), shingles(after))) <= tolerance
    same = defaultdict(set)
    for r in rows:
        same[docs[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in same.values())


def test_digest_matches_python(spark, tiny):
    table = spark.read.parquet(f"{tiny}/documents.parquet")
    docs = {r.doc_id: r.text or "" for r in table.collect()}
    check(fingerprint.digest(table).collect(), docs, 0.2)


def test_small_texts_are_exact(spark):
    docs = {9: "a b c d e f g h i j k l", 7: "", 5: None, 3: "one", 2: "a b c d e f g h i j k m", -4: "é ü ñ 𝄞 x y"}
    df = spark.createDataFrame([(k, v, "s", "h") for k, v in docs.items()], DOCS)
    rows = fingerprint.digest(df).collect()
    check(rows, {k: v or "" for k, v in docs.items()}, 1e-9)


def test_one_document_follows_itself(spark):
    rows = fingerprint.digest(spark.createDataFrame([(1, "abcdef", "", "")], DOCS)).collect()
    assert rows[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and rows[0].near_next == 1.0


def test_empty_null_and_repeated_ids(spark):
    assert fingerprint.digest(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(None, "abcdef", "", ""), (2, "b b b", "", ""), (2, "a a a", "", ""), (3, "xyz", "", "")], DOCS)
    rows = {(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint.digest(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows == {(None, 6, sha("abcd")), (2, 5, sha("b b x")), (2, 5, sha("a a x")), (3, 3, sha("xya"))}


def test_sketches_merge(spark):
    df = spark.createDataFrame([(" ".join(map(str, range(900))), " ".join(map(str, range(700, 1500))))], "a string, b string")
    df = fingerprint.with_sketches(df, {"sa": "a", "sb": "b"}, k=256)
    near, far, inside, n, back = df.select(
        fingerprint.resemblance(F.col("sa"), F.col("sb"), 256), F.size(fingerprint.merge(F.col("sa"), F.col("sb"), 256)), fingerprint.containment(F.col("sb"), F.col("sa"), 256), fingerprint.distinct_shingles(F.col("sa"), 256),
        fingerprint.from_text(fingerprint.as_text(F.col("sa"))) == F.col("sa"),
    ).first()
    assert abs(near - 196 / 1496) < 0.08 and far == 256 and abs(inside - 196 / 796) < 0.12 and abs(n - 896) < 200 and back


def taken(spark, rows, target):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int")
    return mixing.mix(df, target).collect()


def corpus():
    sizes = {"big": 600, "mid": 120, "small": 30, None: 10}
    return [(1000 * k + i, s, "w " * (5 + i % 7), 0) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]


def tokens_of(rows):
    held = defaultdict(int)
    for r in rows:
        held[r[1]] += len(r[2].split())
    return held


def test_repeats_stay_within_the_limit(spark):
    rows = corpus()
    out = taken(spark, rows, mixing.Target(repeats=2.0, block_tokens=64))
    have, used, times = tokens_of(rows), defaultdict(int), defaultdict(int)
    for r in out:
        used[r.source] += r["__tokens"]
        times[r.doc_id] += 1
    assert set(times) == {r[0] for r in rows} and max(times.values()) <= 2
    epochs = {s: used[s] / have[s] for s in have}
    assert abs(epochs["big"] - 1) < 1e-9 and 1.8 < epochs[None] <= 2.0 and epochs["mid"] < epochs["small"] < epochs[None]
    weights = {r.source: r["__weight"] for r in out}
    total = sum(used.values())
    assert abs(sum(weights.values()) - 1) < 1e-6
    assert all(abs(used[s] / total - weights[s]) < 0.02 for s in have)


def test_entropy_target_and_budget(spark):
    rows = corpus()
    out = taken(spark, rows, mixing.Target(repeats=None, entropy=0.9, budget=2000.0, block_tokens=64))
    weights = {r.source: r["__weight"] for r in out}
    entropy = -sum(w * math.log(w) for w in weights.values()) / math.log(len(weights))
    assert abs(entropy - 0.9) < 1e-3
    used = defaultdict(int)
    for r in out:
        used[r.source] += r["__tokens"]
    for s, w in weights.items():
        assert w * 2000 - 12 <= used[s] <= w * 2000 + 1e-6
    # any long run of the mix holds the sources by their weights
    half = sorted(out, key=lambda r: r["__place"])[: len(out) // 2]
    part = defaultdict(int)
    for r in half:
        part[r.source] += r["__tokens"]
    assert all(abs(part[s] / sum(part.values()) - weights[s]) < 0.12 for s in weights)


def test_mix_of_odd_tables(spark):
    assert taken(spark, [], mixing.Target()) == []
    out = taken(spark, [(1, "a", None, 0), (2, "a", "", 0), (3, None, "x y", 0), (3, None, "x y", 0), (None, "b", "z", 0)], mixing.Target())
    assert sorted((r.doc_id or 0) for r in out)[-4:].count(3) >= 2 and {r.doc_id for r in out} == {1, 2, 3, None}


def test_cuts_equal_a_plain_running_sum(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_BITS", 2)  # many runs in a small table
    target = mixing.Target(repeats=1.7, block_tokens=32)
    rows = corpus() + [(9000 + i, "small", "", 0) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int")
    given = {r.key: r for r in mixing.plan(df, target).collect()}
    held = defaultdict(list)
    plans = spark.createDataFrame([(k, g.blocks, g.full) for k, g in given.items()], "__key string, blocks int, full int")
    where = mixing.position(mixing.block(F.col("__rank"), F.col("blocks"), target), F.col("blocks"), F.col("__key"), F.col("full"), target)
    for r in mixing.keyed(df).join(plans, "__key").withColumn("at", where).withColumn("turn", mixing.turn(F.col("__rank"), F.col("full"), target)).collect():
        held[r["__key"]].append((r.at, r.turn, r["__tokens"], r.doc_id))
    got, want = defaultdict(int), defaultdict(int)
    for r in mixing.mix(df, target).collect():
        got[r.doc_id] += 1
    for key, docs in held.items():
        more, used = (given[key].epochs % 1) * given[key].tokens, 0
        for _, _, n, doc in sorted(docs):
            used += n
            want[doc] = 1 if n == 0 else int(given[key].epochs) + (used <= more)
    assert any(g.blocks > 8 for g in given.values()) and got == want


def test_each_epoch_has_a_permutation_of_its_own(spark):
    for n in (1, 2, 7, 64, 1000):
        rows = spark.range(n).select(F.col("id").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("e"))
        at = mixing.position(F.col("b"), F.lit(n), F.lit("=s"), F.col("e"), mixing.Target())
        got = defaultdict(dict)
        for r in rows.select("b", "e", at.alias("at")).collect():
            got[r.e][r.b] = r.at
        assert all(sorted(m.values()) == list(range(n)) for m in got.values())
        if n >= 64:
            orders = [[m[b] for b in range(n)] for m in got.values()]
            assert all(abs(np.corrcoef(x, y)[0, 1]) < 0.35 for x, y in ((orders[0], orders[1]), (orders[1], orders[2]), (orders[0], list(range(n)))))


def test_epochs_repeat_documents_in_other_orders(spark):
    rows = corpus()
    out = taken(spark, rows, mixing.Target(repeats=2.0, block_tokens=64))
    again = sorted({r.doc_id for r in out if r["__epoch"] == 1 and r.source == "small"})
    order = {e: sorted((d for d in again), key=lambda d, e=e: next(r["__place"] for r in out if r.doc_id == d and r["__epoch"] == e)) for e in (0, 1)}
    assert len(again) > 8 and order[0] != order[1]
