"""Links in nodes with more members than neighbours in the order of labels."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import ngram_join
from gridloom.llm.shared import settle

WORDS = 104  # 100 shingles


def one_node(spark, texts, settings):
    """(node, root) of texts that all lie in one node with the same label and signature: every pair is likely."""
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("digest", ngram_join.digest_of(F.col("text")))
    classes = df.select(F.col("doc_id").alias("nid"), "doc_id", "digest", F.lit(b"\1" * settings.values).alias("sig"), F.array(F.lit(5 << 12).cast("long")).alias("labels"))
    return {(r.node, r.root) for r in ngram_join.linked(settle(classes, "test-node"), df, settings)[0].collect()}


def text(k):
    return [f"d{k}w{i}" for i in range(WORDS)]


def near(base, k, changed=5):
    return base[: WORDS - changed] + [f"c{k}w{i}" for i in range(changed)]


@pytest.mark.parametrize("settings", [ngram_join.Settings(), ngram_join.Settings(share=40), ngram_join.Settings(block=8, crowd=16)])
def test_far_texts_of_a_crowded_node_are_linked(spark, settings):
    texts = [text(k) for k in range(200)]
    texts[150] = near(texts[60], 150)
    texts[199] = near(texts[100], 199)
    texts[30] = []  # has no shingles
    assert one_node(spark, texts, settings) == {(60, 60), (150, 60), (100, 100), (199, 100)}


def test_a_class_is_reached_by_its_only_linked_member(spark):
    """A chain: of a family of copies in a crowded node one has a partner that is unlike the others."""
    settings = ngram_join.Settings(block=16, crowd=32)
    rng = np.random.default_rng(4)
    texts = [text(k) for k in range(400)]
    base = texts[0]
    for k in range(1, 100):
        texts[k] = near(base, k)
    texts[350] = [f"e{i}" for i in range(9)] + texts[70][9:]  # like 70; its end differs from the others' too
    for k in rng.choice(np.arange(100, 340), 40, replace=False):
        texts[k] = near(base, k, 40)  # likeness 0.4
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    like = [(a, b) for a in range(400) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert [b for a, b in like if a == 350] == [70]
    want = {(k, 0) for k in [*range(100), 350]}
    assert one_node(spark, texts, settings) == want


def test_every_pair_of_different_roots_has_one_cell(spark):
    rng = np.random.default_rng(5)
    members = [(g, int(n), int(n) if rng.random() < 0.3 else g * 1000) for g in range(4) for n in range(g * 1000, g * 1000 + 40 * g + 1)]
    rows = spark.createDataFrame(members, "g long, nid long, root long")
    cells = {}
    for r in ngram_join.dealt(rows, ["g"], 8).collect():
        cells.setdefault((r.g, r.i, r.j), []).append(r)
    met = [tuple(sorted((a.nid, b.nid))) for (_, i, j), held in cells.items() for a in held for b in held if a.side == i and b.side == j and (a.nid < b.nid or i != j) and a.root != b.root]
    assert sorted(met) == sorted({tuple(sorted((a[1], b[1]))) for a in members for b in members if a[0] == b[0] and a[2] != b[2]})
    assert all(len(held) <= 60 for held in cells.values())


def test_pipeline_drops_near_copies_in_a_crowded_node(spark, monkeypatch):
    def alike(docs, settings):
        return docs.select("doc_id", "digest", F.lit(b"\1" * settings.values).alias("sig"), F.array(F.lit(5 << 12).cast("long")).alias("labels"))

    monkeypatch.setattr(ngram_join, "signatures", alike)
    texts = [text(k) for k in range(200)]
    for a, b in ((60, 20), (150, 60), (199, 100)):  # 150 by way of 60
        texts[a] = near(texts[b], a)
    df = spark.createDataFrame([(k, " ".join(t), "en", "web", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df.coalesce(1), "").collect()}
    assert kept == set(range(200)) - {60, 150, 199}


def apart(spark, texts, settings):
    """As ``one_node``, but no two texts meet in a node, and their signatures are unlike."""
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(t), rng.bytes(settings.values), [(k + 1) << 12]) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sig binary, labels array<bigint>").withColumn("digest", ngram_join.digest_of(F.col("text")))
    classes = settle(df.select(F.col("doc_id").alias("nid"), "doc_id", "digest", "sig", "labels"), "test-apart")
    return {(r.node, r.root) for r in ngram_join.linked(classes, df.select("doc_id", "text", "digest"), settings)[0].collect()}


@pytest.mark.parametrize("settings", [ngram_join.Settings(), ngram_join.Settings(block=8, crowd=4), ngram_join.Settings(often=1, last=50)])
def test_links_of_texts_that_meet_in_no_node(spark, settings):
    rng = np.random.default_rng(7)
    line = [f"common{i}" for i in range(30)]
    texts = [[f"t{k}w{i}" for i in range(rng.integers(1, 60))] + (line if k % 3 == 0 else []) for k in range(120)]
    for k in range(120, 240):  # likeness from far below the threshold to far above
        base = texts[int(rng.integers(0, 120))]
        cut = int(rng.integers(0, 1 + len(base) // 6))
        texts.append(base[cut:] + [f"n{k}w{i}" for i in range(int(rng.integers(0, 3)))])
    texts = [list(t) for t in dict.fromkeys(map(tuple, [*texts, []]))]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    want = {(k, r) for k, r in enumerate(root) if root.count(r) > 1}
    assert len(want) > 60
    assert apart(spark, texts, settings) == want


def test_pipeline_drops_near_copies_that_meet_in_no_node(spark, monkeypatch):
    def alone(docs, settings):
        sig = F.substring(F.concat(*[F.sha2(F.concat(F.lit(str(k)), "text"), 512) for k in range(settings.values // 128)]), 1, settings.values).cast("binary")
        return docs.select("doc_id", "digest", sig.alias("sig"), F.array(F.shiftleft(F.xxhash64("digest"), 12)).alias("labels"))

    monkeypatch.setattr(ngram_join, "signatures", alone)
    texts = [text(k) for k in range(50)]
    texts[40] = near(texts[10], 40)
    df = spark.createDataFrame([(k, " ".join(t), "en", "web", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == set(range(50)) - {40}


def given(spark, monkeypatch, texts, roots):
    """The rows that leave the prefixes' shingles, and the pairs of ``unmet``."""
    kept = {}

    def keep(df, name):
        kept[name] = settle(df, name)
        return kept[name]

    monkeypatch.setattr(ngram_join, "settle", keep)
    known = spark.createDataFrame([(k, k, r, None) for k, r in enumerate(roots)], "key long, nid long, root long, crowd long")
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "key long, text string")
    pairs = [(r.a, r.b) for r in ngram_join.unmet(df, known, ngram_join.Settings()).collect()]
    return kept["ngram-prefixes"].count(), pairs


def test_texts_of_one_class_leave_no_pairs(spark, monkeypatch):
    base = text(0)
    texts = [near(base, k) for k in range(60)] + [near(base, k, 8) for k in range(60, 63)]
    rows, pairs = given(spark, monkeypatch, texts, [0] * 60 + [60, 61, 62])
    assert all(a >= 60 for a, _ in pairs) and {(60, 0), (61, 60)} <= set(pairs)
    assert rows <= 5 * len(pairs)


def test_a_run_of_shared_shingles_gives_its_pair_once(spark, monkeypatch):
    base = text(0)
    rows, pairs = given(spark, monkeypatch, [near(base, k, 1) for k in range(30)], range(30))
    assert sorted(pairs) == [(a, b) for a in range(30) for b in range(a)]
    assert rows <= 2 * len(pairs)


def test_parities_never_rule_out_a_link():
    rng, settings = np.random.default_rng(8), ngram_join.Settings()
    told = 0
    for k in range(300):
        n, other = int(rng.integers(1, 400)), int(rng.integers(0, 90))
        one = [f"w{k}x{i}" for i in range(n)]
        two = one[int(rng.integers(0, 1 + n // 5)) :] + [f"o{k}x{i}" for i in range(other)]
        texts = pa.array([" ".join(one), " ".join(two)])
        sets, marks = ([np.frombuffer(x.as_py(), np.uint64) for x in make(texts, settings)] for make in (ngram_join.shingle_sets, ngram_join.parities))
        both, either = ngram_join.in_common(*sets)
        most, least = ngram_join.most_in_common(*marks)
        assert ngram_join.most_in_common(*marks[::-1]) == (most, least)
        assert most >= both and least <= either
        told += both < 0.7 * either and most < 0.8 * least
    assert told > 50


def test_texts_are_worked_on_where_they_lie(spark):
    settings = ngram_join.Settings()
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "g h"), (4, ""), (None, "i j")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", ngram_join.digest_of(F.col("text")))
    asked = texts.filter("doc_id in (1, 4) or doc_id = 3").select((F.col("doc_id") * 10).alias("nid"), "doc_id", "digest").distinct()
    made = ngram_join.of_texts(texts, asked, ngram_join.shingle_sets, settings)
    assert {r.nid: len(r.hashes) for r in made.collect()} == {10: 16, 30: 8, 40: 0} and made.count() == 3
    assert ngram_join.of_texts(texts, asked.limit(0), ngram_join.shingle_sets, settings).count() == 0
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("MapInArrow")  # the texts stand below the task's work, only its bytes are joined
