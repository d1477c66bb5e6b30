"""Nearest neighbours, n-gram join, packing and the pipeline against plain Python."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import ann, links, ngram_join, packing
from gridloom.llm.shared import settle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---------------------------------------------------------------- nearest neighbours


def nearest_by_force(rows, k=5):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    x = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    out = {}
    for n, i in enumerate(ids):
        if i % 50 == 0:
            sim = x @ x[n]
            out[i] = sorted(((-round(sim[m], 12), j) for m, j in enumerate(ids) if j != i))[:k]
    return out


def test_nearest_finds_what_brute_force_finds(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = nearest_by_force([(r.vec_id, r.embedding) for r in table.collect()])
    got = defaultdict(list)
    for r in ann.digest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert all(abs(s + w) < 1e-9 for q in want for (_, s), (w, _) in zip(got[q], want[q]))


def test_nearest_with_small_leaves_needs_the_graph(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(12)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = nearest_by_force([(i, np.float32(v).tolist()) for i, v in rows])
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, 5, ann.Settings(leaf=128, orders=2, degree=12)).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    assert sum((q, j) in found for q, near in want.items() for _, j in near) / (5 * len(want)) > 0.9


def test_nearest_under_the_registered_settings_needs_the_graph(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((250, 32))
    points = centres[rng.integers(0, 250, 5000)] + 1.2 * rng.standard_normal((5000, 32))
    table = settle(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(points)], "vec_id long, embedding array<float>"), "test-vectors")
    want = {(q, j) for q, near in nearest_by_force([(r.vec_id, r.embedding) for r in table.collect()]).items() for _, j in near}
    assert table.count() > 15 * ann.Settings().leaf
    nodes, _ = ann.nodes_of(ann.usable(table), 6)
    leaves = {(r.u, r.v) for r in ann.first_edges(nodes, nodes.count(), ann.Settings()).filter("u % 50 = 0").collect()}
    assert len(want & leaves) / len(want) < 0.6
    found = {(r.query_id, r.vec_id) for r in ann.digest(table).collect()}
    assert len(want & found) / len(want) > 0.9


def test_a_graph_that_never_settles_is_no_answer(spark):
    table = spark.createDataFrame([(k, [float(k % 17), float(k % 13), 1.0]) for k in range(300)], "vec_id long, embedding array<float>")
    with pytest.raises(RuntimeError, match="still changes"):
        ann.digest(table, ann.Settings(leaf=8, orders=1, rounds=1, change=-1.0))


def test_nearest_of_odd_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int, node long, score double"
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(40)] + [(50, [0.5, -1.0, 2.0]), (100, None), (150, [0.0, 0.0, 0.0]), (200, [1.0, None, 2.0]), (250, [float("nan"), 1.0, 1.0]), (300, [1.0, float("inf"), 0.0]), (350, [1.0, 2.0]), (None, same), (400, [2.0, 4.0, 6.0]), (400, [2.0, 4.0, 6.0])]
    out = ann.digest(spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in rows], kind)).orderBy("query_id", "rank").collect()
    got = defaultdict(list)
    for r in out:
        got[r.query_id].append(r.vec_id)
    assert set(got) == {0, 50, 400} and got[0] == [1, 2, 3, 4, 5]
    assert got[50][:1] in ([0], [400]) and len(got[50]) == 5
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, 1, 0.0), (50, [0.0, 1.0], 1, 1, 0.0), (3, [1.0, 1.0], 1, 1, 0.0)], kind)
    assert {(r.query_id, r["rank"], r.vec_id) for r in ann.digest(few).collect()} == {(0, 1, 3), (0, 2, 50), (50, 1, 3), (50, 2, 0)}
    assert ann.digest(few.limit(0)).count() == 0
    assert ann.digest(few.limit(1)).count() == 0


# ---------------------------------------------------------------- components and near copies


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 5), (200, 201), (201, 203), (300, 300)] + [(1000, 2000 + i) for i in range(50)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in [*range(61), 100]) and got[203] == got[200] == got[201] == 200
    assert all(got[2000 + i] == 1000 for i in range(50)) and 300 not in got
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_path(spark):
    path = spark.range(1, 20_000).select((F.col("id") * 7919 % 20_000).alias("a"), ((F.col("id") + 1) * 7919 % 20_000).alias("b"))
    assert {r.root for r in links.components(path).select("root").distinct().collect()} == {0}


def shingles(text):
    w = text.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def linked_by_force(docs):
    """{doc_id: (class_id, text_id, n_links, n_copies)} of {doc_id: text}."""
    by_text = defaultdict(list)
    for d, t in docs.items():
        by_text[t].append(d)
    sets = [(min(ids), shingles(t)) for t, ids in by_text.items()]
    posting = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            posting[x].append(k)
    both = defaultdict(int)
    for ks in posting.values():
        for i in range(len(ks)):
            for j in range(i):
                both[ks[j], ks[i]] += 1
    root, count = list(range(len(sets))), defaultdict(int)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for (i, j), n in both.items():
        if n / (len(sets[i][1]) + len(sets[j][1]) - n) >= 0.8:
            count[i] += 1
            count[j] += 1
            root[top(i)] = top(j)
    least = defaultdict(lambda: 1 << 60)
    for k, (rid, _) in enumerate(sets):
        least[top(k)] = min(least[top(k)], rid)
    number = {rid: k for k, (rid, _) in enumerate(sets)}
    return {d: (least[top(number[min(ids)])], min(ids), count[number[min(ids)]], len(ids)) for ids in by_text.values() for d in ids}


def test_ngram_join_finds_all_links(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = linked_by_force({r.doc_id: r.text or "" for r in table.collect()})
    got = {r.doc_id: (r.class_id, r.text_id, r.n_links, r.n_copies) for r in ngram_join.join(table).collect()}
    assert got == want
    assert sum(v[2] > 0 for v in want.values()) > 10


def test_ngram_join_of_a_large_family(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    docs = {}
    for k in range(400):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 4)):
            words[at] = f"x{k}"
        docs[k] = " ".join(words)
    docs |= {1000: "a b c", 1001: "a b c", 1002: "a b c d", 1003: "", 1004: "", 1005: " \n", 1006: "q " * 30000}
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in docs.items()], DOCS)
    got = {r.doc_id: (r.class_id, r.text_id, r.n_links, r.n_copies) for r in ngram_join.join(df, ngram_join.Settings(block=64)).collect()}
    assert got == linked_by_force(docs)


def test_ngram_join_of_short_copies_quoted_by_many(spark):
    rng = np.random.default_rng(3)
    docs = {}
    for g in range(12):
        base = [f"b{g}_{k}" for k in range(60)]
        for k in range(150):
            docs[g * 1000 + k] = " ".join(base + [f"q{g}_{k}_{i}" for i in rng.permutation(56)])
        docs[g * 1000 + 900] = " ".join(base)
        docs[g * 1000 + 901] = " ".join(base[:-1] + [f"end{g}"] + [f"tail{g}_{i}" for i in range(5)])
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in docs.items()], DOCS)
    want = linked_by_force(docs)
    assert all(want[g * 1000 + 901][0] == g * 1000 + 900 for g in range(12))
    got = {r.doc_id: (r.class_id, r.text_id, r.n_links, r.n_copies) for r in ngram_join.join(df).collect()}
    assert got == want


def test_texts_of_a_node_meet_past_its_unlike_first(spark):
    like, unlike = b"\1" * 128, b"\2" * 128
    rows = [(g * 10 + k, sig, [g << 12 | low]) for g in range(1, 41) for k, (sig, low) in enumerate([(unlike, 0), (like, 0x500), (like, 0x900)])]
    df = spark.createDataFrame(rows, "nid long, sig binary, labels array<long>")
    settings = ngram_join.Settings()
    members = ngram_join.trie_members(df, settings).join(df.select("nid", "sig"), "nid").withColumn("root", F.col("nid"))
    got = {(r.a, r.b) for r in ngram_join.ties(members, [12, 8, 4], settings.beside, settings).collect()}
    assert got == {(g * 10 + 2, g * 10 + 1) for g in range(1, 41)}


def test_a_node_of_many_members_is_cut_and_still_meets_its_first(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HAND", 50)
    settings = ngram_join.Settings(share=40)
    sigs = [bytes([k % 7 + 1]) * 128 for k in range(700)]
    df = spark.createDataFrame([(k, sigs[k], [5 << 12 | k % 7 << 8]) for k in range(700)], "nid long, sig binary, labels array<long>")
    members = ngram_join.trie_members(df, settings).join(df.select("nid", "sig"), "nid").withColumn("root", F.col("nid"))
    assert members.first().shares == 18
    got = [(r.a, r.b) for r in ngram_join.ties(members, [12, 8, 4], settings.beside, settings).collect()]
    assert all(a > b and a % 7 == b % 7 for a, b in got) and len(set(got)) == len(got)
    first = {b for a, b in got if b == 0}
    assert first == {0} and sum(b == 0 for _, b in got) == 99  # every text like the node's first
    known = ngram_join.ties(members.withColumn("root", F.col("nid") % 7), [12, 8, 4], settings.beside, settings)
    assert known.count() == 0


def test_lists_stay_short_where_all_meet_a_node_s_first(spark):
    # the first one in the order of labels has the greatest nid, and all meet it
    settings = ngram_join.Settings(share=100)
    df = spark.createDataFrame([(k, b"\1" * 128, [5 << 12 | (k < 599) << 8]) for k in range(600)], "nid long, sig binary, labels array<long>")
    members = ngram_join.trie_members(df, settings).join(df.select("nid", "sig"), "nid").withColumn("root", F.col("nid"))
    lists = {r.a: [x.b for x in r.near] for r in ngram_join.met_lists(members, [12], settings.beside, settings).collect()}
    assert all(len(near) <= 2 * settings.beside + 2 and len(set(near)) == len(near) for near in lists.values())
    pairs = [(r.a, r.b) for r in ngram_join.ties(members, [12], settings.beside, settings).collect()]
    assert sorted(pairs) == sorted({(max(a, b), min(a, b)) for a, near in lists.items() for b in near})
    assert sum(a == 599 for a, _ in pairs) == 599


def test_links_at_the_threshold_are_found(spark):
    """5,000 pairs at 0.80 to 0.82; half of the texts have a copy at 0.98 beside them."""
    pairs, docs = 5000, []
    for f in range(pairs):
        base = [f"f{f}w{k}" for k in range(104)]  # 100 shingles
        docs.append((4 * f, " ".join(base)))
        cut = 104 - (11 - f % 2)  # so many changed words at the end are as many shingles
        other = base[:cut] + [f"g{f}w{k}" for k in range(104 - cut)]
        docs.append((4 * f + 2, " ".join(other)))
        if f % 2:
            docs += [(4 * f + 1, " ".join(["x", *base[1:]])), (4 * f + 3, " ".join(["y", *other[1:]]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    classes = {r.doc_id: r.class_id for r in ngram_join.join(df).collect()}
    sets = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    a, b = (sets(docs[k][1].split()) for k in (0, 1))
    assert 0.8 <= len(a & b) / len(a | b) <= 0.81
    lost = sum(classes[4 * f] != classes[4 * f + 2] for f in range(pairs))
    assert lost <= (1 - ngram_join.Settings().recall) * pairs


def test_pages_of_one_template_are_not_gathered(spark):
    rng = np.random.default_rng(8)
    frame = [f"t{k}" for k in range(150)]
    docs = {k: " ".join(frame + [f"p{k}_{i}" for i in range(46)]) for k in range(600)}  # likeness 0.6 in pairs
    for k in range(0, 600, 12):
        words = docs[k].split()
        words[int(rng.integers(150, 190))] = "changed"
        docs[1000 + k] = " ".join(words)
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in docs.items()], DOCS)
    texts = ngram_join.texts_of(df)
    classes = ngram_join.signatures(texts, ngram_join.Settings()).withColumn("nid", F.col("doc_id"))
    found = ngram_join.linked(settle(classes, "test-classes"), texts, ngram_join.Settings())[0].collect()
    assert {(r.node, r.root) for r in found} == {(k + d, k) for k in range(0, 600, 12) for d in (0, 1000)}
    assert {r.doc_id: (r.class_id, r.text_id, r.n_links, r.n_copies) for r in ngram_join.join(df).collect()} == linked_by_force(docs)


def test_ngram_join_of_odd_rows(spark):
    df = spark.createDataFrame([], DOCS)
    assert ngram_join.join(df).count() == 0
    text = " ".join(map(str, range(50)))
    rows = [(None, text, "", "", 1), (7, text, "", "", 1), (7, text, "", "", 1), (8, text + " x", "", "", 1), (9, None, "", "", 1), (7, "other words that are here now", "", "", 1)]
    got = sorted((r.doc_id or -1, r.class_id, r.text_id, r.n_links, r.n_copies) for r in ngram_join.join(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(-1, None, None, 0, 1), (7, 7, 7, 0, 1), (7, 7, 7, 1, 2), (7, 7, 7, 1, 2), (8, 7, 8, 1, 1), (9, 9, 9, 0, 1)]


# ---------------------------------------------------------------- packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["", " ", "a", " a", "a ", "a  b", "a \n b", "it's  they'll 'd", "x<|endoftext|>y z", "é ü 漢字 𝄞", "a b  c", "1 22 333,444", "\n\n\n x", "!" * 500, "tab\tx y", "a  b", "　 q \x1f r", "ſ K"]


def test_encoder_equals_the_tokenizer(tokenizer, spark, tiny):
    texts = ODD + [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect() if r.text]
    rng = random.Random(6)
    points = [*map(chr, range(32, 127)), *" \t\n\r\x1c\x85\xa0\u2003\u3000", *(chr(rng.choice((rng.randrange(0x20, 0x3000), rng.randrange(0xE000, 0x110000)))) for _ in range(400)), " ", " ", "'s", "<|endoftext|>"]
    texts += ["".join(rng.choices(points, k=rng.randrange(40))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text]
    for text, ids in zip(texts, packing.encoder(None)(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:80]


def test_equal_rows_spread_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = settle(packing.encoded(spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words").alias("text"))).withColumn("row", F.monotonically_increasing_id()), "test-ids")
        sizes = [r["count"] for r in packing.laid_out(ids, 8).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 1000


def check_pieces(rows, docs, tokenizer, length=2048):
    """docs: list of (doc_id, text), repeated rows too."""
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t in docs}
    times = defaultdict(int)
    for d, _ in docs:
        times[d] += 1
    held, sequences = defaultdict(lambda: defaultdict(int)), defaultdict(list)
    for r in rows:
        want = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(want) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        for at in range(r.start, r.start + r.length):
            held[r.doc_id][at] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(held) == set(ids)
    assert all(held[d][at] == times[d] for d in ids for at in range(len(ids[d])))
    padding = total = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
        total += at
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0
    return total


def test_packing(spark, tiny, tokenizer):
    table = spark.read.parquet(f"{tiny}/documents.parquet")
    check_pieces(packing.pack(table).collect(), [(r.doc_id, r.text) for r in table.collect()], tokenizer)


def test_packing_of_odd_rows(spark, tokenizer):
    rows = [(k, t, "x", 1) for k, t in enumerate(ODD)] + [(100, None, "x", 1), (101, "long words here " * 4000, "x", 1), (5, ODD[5], "x", 1), (None, "no id", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, ids int")
    check_pieces(packing.pack(df).collect(), [(r[0], r[1]) for r in rows], tokenizer)
    assert packing.pack(df.limit(0)).count() == 0


def test_hilbert_neighbours_are_adjacent():
    bits = 3
    cells = np.array([[a, b, c, d] for a in range(8) for b in range(8) for c in range(8) for d in range(8)])
    keys = packing.hilbert(cells, bits)
    assert sorted(keys) == list(range(8**4))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tiny, tokenizer, tmp_path):
    import corpus_pipeline

    from tests.llm.test_text_operators import base_spans

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(settle(stage(spark, kept[-1], tiny), f"test-{name}"))
    assert all(k.columns == columns for k in kept[:-1])
    raw, good, single, hidden, mixed = [{r.doc_id: r for r in k.collect()} for k in kept[:-1]]
    bad = {r.doc_id for r in spark.read.parquet(f"{tiny}/labels.parquet").filter("quality = 0").collect()}
    fine = {r.doc_id for r in spark.read.parquet(f"{tiny}/labels.parquet").filter("quality = 1").collect()}
    assert set(good) <= set(raw) and len(fine & set(good)) > 0.95 * len(fine & set(raw)) and len(bad & set(good)) < 0.5 * len(bad & set(raw)) + 1
    classes = linked_by_force({d: r.text or "" for d, r in good.items()})
    assert set(single) == {c for c, *_ in classes.values()} and kept[2].count() == len(single)
    for d, r in hidden.items():
        text = single[d].text or ""
        assert ("[SECRET]" in (r.text or "")) == bool(base_spans(text)) and (base_spans(text) or r == single[d])
    assert set(hidden) == set(single) == set(mixed)
    check_pieces(kept[5].collect(), [(r.doc_id, r.text) for r in kept[4].collect()], tokenizer)


def test_pipeline_keeps_odd_tables(spark, tmp_path):
    import corpus_pipeline

    folder = f"file://{tmp_path}"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "one two three four five six", "en", "b", 27), (4, "token=abcdefg1 here", "en", None, 19)]
    kind = DOCS + ", __tokens int, text_id int"
    spark.createDataFrame([(*r, 1, 2) for r in rows], kind).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} >= {None, 4} and sum(r.length for r in out) > 0
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/empty/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/empty").count() == 0


def test_near_copies_of_one_id(spark):
    import corpus_pipeline

    long = " ".join(f"word{k}" for k in range(200))
    rows = [(5, long, "en", "a", 0), (5, long + " more", "en", "a", 0), (5, "a clean text of its own", "en", "a", 0), (5, "a clean text of its own", "en", "a", 0), (6, long, "en", "a", 0), (None, long, "en", "a", 0), (7, None, "en", "a", 0)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 5, 5, 7]
    mine = [r.text for r in kept if r.doc_id == 5]
    assert "a clean text of its own" in mine and sum(t.startswith(long) for t in mine) == 1
