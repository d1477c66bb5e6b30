"""Order, edits, stages, frame verbs and text tables on small tables."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions.types import extraction_advice
from gridloom.operators import edit, frame, order, profile, search, stages, texttable
from gridloom.sources import files


@pytest.fixture(scope="module")
def small(spark):
    df = spark.createDataFrame([(k, f"n{k}", k * 1.5) for k in range(1, 8)], "id bigint, name string, x double")
    return order.with_row_index(df, [("id", True)])


def values(df, column, by="_row"):
    return [r[column] for r in df.orderBy(by).collect()]


def test_row_index_counts_every_row(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 10).alias("g"))
    rows = order.with_row_index(df, [("g", False), ("k", True)]).orderBy("_row").collect()
    assert [r["_row"] for r in rows] == list(range(1, 5001))
    keys = [(r.g is not None, -(r.g or 0), r.k) for r in rows]
    assert keys == sorted(keys)
    assert order.with_row_index(df.limit(0), [("k", True)]).count() == 0


def test_sort_keys():
    keys = order.toggled(order.toggled([], "a"), "b")
    assert keys == [("a", True), ("b", True)] and order.toggled(keys, "a") == [("a", False), ("b", True)]
    assert order.valid(keys, ["b", "c"]) == [("b", True)]


def test_row_addresses():
    assert [order.resolve_row(r, 10) for r in (0, 1, 10, -1, -10)] == [1, 1, 10, 10, 1]
    for bad in (11, -11):
        with pytest.raises(ValueError):
            order.resolve_row(bad, 10)
    assert [order.page_start(t, 2500) for t in (1, 1250, 2500)] == [0, 749, 1500] and order.page_start(3, 10) == 0


def test_addresses_and_neighbours(small):
    hits = search.find_cells(small, "x", "gt", "6")
    assert values(hits, "address", "row") == ["C6", "C7", "C8"]
    around = search.with_neighbours(hits).orderBy("row").collect()
    assert [(r.next_row, r.previous_row) for r in around] == [(6, 7), (7, 5), (5, 6)]
    assert search.nearest(hits, 6, 0).first().row == 6 and search.nearest(hits.filter("false"), 1, 1).count() == 0
    assert [search.letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_insert_and_delete(small, monkeypatch):
    out = edit.insert_rows(small, [1, 3, 3, 99])
    assert values(out, "id") == [None, 1, 2, None, None, 3, 4, 5, 6, 7, None] and values(out, "_row") == list(range(1, 12))
    assert values(edit.delete_rows(small, [7, 1]), "id") == [2, 3, 4, 5, 6]
    assert edit.delete_rows(small, list(range(1, 8))).columns == small.columns
    assert values(edit.append_row(small), "id")[-1] is None
    at = lambda *rows: small.sparkSession.createDataFrame([(r,) for r in rows], "p long")
    monkeypatch.setattr(edit, "BLOCK", 3)
    for places in ([1, 3, 3, 99], [], [8], list(range(1, 9)) * 2):
        assert sorted(map(str, edit.insert_rows(small, at(*places)).collect())) == sorted(map(str, edit.insert_rows(small, places).collect()))
    for places in ([7, 1], [], [2, 2], list(range(1, 8))):
        assert sorted(map(str, edit.delete_rows(small, at(*places)).collect())) == sorted(map(str, edit.delete_rows(small, places).collect()))
    for bad in (lambda: edit.insert_rows(small, at(0)), lambda: edit.insert_rows(small, at(None)), lambda: edit.delete_rows(small, at(1, 8))):
        with pytest.raises(ValueError):
            bad()
    for bad in (lambda: edit.insert_rows(small, [0]), lambda: edit.delete_rows(small, [0]), lambda: edit.delete_rows(small, [8])):
        with pytest.raises(ValueError):
            bad()


def test_columns(spark, small):
    assert edit.add_column(small.withColumn("Column_1", F.lit(1)), 0).columns[0] == "Column_2"
    one = edit.delete_column(spark.createDataFrame([(1,), (2,)], "a int"), 0)
    assert one.columns == ["Column_1"] and one.dtypes[0][1] == "string" and one.count() == 2 and one.filter("Column_1 is not null").count() == 0
    for name in ("", "1a", "123", "class", "a b", "select", "SELECT", "a" * 101, "NAME", "a.b"):
        with pytest.raises(ValueError):
            edit.rename_column(small, "id", name)
    assert "a_b" in edit.rename_column(small, "id", "a_b").columns and edit.name_error("id", ["id", "x"], "id") is None


def test_patches(spark, small):
    patches = spark.createDataFrame([(2, "x", "8", 1), (2, "x", "9.5", 3), (2, "x", "7", 2), (3, "name", "", 4), (4, "id", "12.9", 5), (99, "id", "1", 6)], "row bigint, col string, value string, seq int")
    out = edit.apply_patches(small, patches)
    assert out.schema == small.schema or out.dtypes == small.dtypes
    assert values(out, "x")[1] == 9.5 and values(out, "name")[2] is None and values(out, "id")[3] == 12 and out.count() == 7
    assert edit.cell(small, patches, 2, "x").first()[0] == 9.5
    assert values(edit.edit_cell(small, 1, "id", "text"), "id")[0] is None
    assert edit.edit_cell(small, 1, "id", "2.5", convert_column=True).dtypes[1] == ("id", "double")
    empty = small.withColumn("new", F.lit(None).cast("string"))
    assert dict(edit.edit_cell(empty, 1, "new", "5").dtypes)["new"] == "bigint"


def test_append_widens(spark):
    a = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    b = spark.createDataFrame([(1.5, 3, 4)], "a double, b bigint, c bigint")
    out = edit.append_relaxed(a, b)
    assert [k for _, k in out.dtypes] == ["double", "double", "string"] and values(out, "c", "a") == ["x", "4"]
    with pytest.raises(ValueError):
        edit.append_relaxed(a, b.withColumnRenamed("a", "z"))


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, "x", {"k": 1}), (2, None, None), (2, None, None)], "a int, b string, m map<string,int>")
    assert stages.fingerprint(a) == stages.fingerprint(a.orderBy(F.desc("a")).repartition(3))
    assert stages.fingerprint(a) != stages.fingerprint(a.limit(2))
    assert stages.fingerprint(a) != stages.fingerprint(a.withColumnRenamed("b", "c"))
    b = a.select("a", "b")
    assert stages.unchanged(b, b, proof=True) and not stages.unchanged(b, b.filter("a = 1"), proof=True)
    assert stages.schema_change(a, b.withColumn("z", F.lit(1))) == {"added": ["z"], "removed": ["m"]}


def test_workbook(spark):
    book = stages.Workbook(spark)
    df = spark.createDataFrame([(1, 20), (2, 40)], "id int, age int")
    book.add("sheet1", df)
    book.add("sheet2")
    assert book.current == "sheet1" and book.get("sheet2").schema() == {} and spark.table("sheet1").count() == 2
    with pytest.raises(ValueError, match="Sheet 'sheet1' already exists"):
        book.add("sheet1", df)
    with pytest.raises(ValueError, match="Sheet 'nonexistent' not found"):
        book.get("nonexistent")
    fork = book.branch("sheet1", "copy")
    book.apply("copy", "SELECT * FROM {df} WHERE age > 30", description="Filter adults")
    assert fork.df.count() == 1 and book.get("sheet1").df.count() == 2 and spark.table("copy").count() == 1
    assert fork.parent == "sheet1" and book.get("sheet1").branches == ["copy"]
    step = book.lineage().first()
    assert (step.sheet, step.step, step.output_schema, step.metadata) == ("copy", 1, {"id": "int", "age": "int"}, {"description": "Filter adults"})
    assert fork.replay(df.union(df)).count() == 2
    for bad in (lambda: book.branch("sheet2", "x"), lambda: book.branch("sheet1", "copy"), lambda: book.apply("sheet1", lambda d: 5), lambda: book.apply("sheet2", "SELECT 1")):
        with pytest.raises(ValueError):
            bad()
    book.remove("copy")
    assert book.get("sheet1").branches == []
    book.remove("sheet1")
    assert book.current == "sheet2" and list(book.stages) == ["sheet2"]


def test_frame_verbs(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, v string"), spark.createDataFrame([(1, "p"), (None, "q")], "k int, v string")
    assert frame.join(a, b, ["k"]).columns == ["k", "v", "v_right"] and frame.join(a, b, ["k"]).count() == 2
    assert frame.join(a, b, ["k"], join_nulls=True).count() == 3 and frame.join(a, b, ["k"], how="full").count() == 4
    with pytest.raises(ValueError):
        frame.join(a, b, ["k"], validate="1:1")
    with pytest.raises(ValueError):
        frame.join(a, b, ["k"], how="sideways")
    with pytest.raises(ValueError):
        frame.transpose(spark.range(20), "id", most=5)
    assert frame.quantile_nearest(spark.createDataFrame([(x,) for x in (1, 2, 2, 10)], "x int").withColumn("g", F.lit(1)), ["g"], "x", 0.5).first().quantile == 2


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "n int, t string")
    facts = {r.column: r for r in profile.profile_columns(df).collect()}
    assert facts["n"].median == 2.0 and facts["n"].std == 1.0 and facts["t"].nulls == 1 and facts["t"].null_percent == 33.33 and facts["t"].distinct == 1
    assert profile.profile_columns(df.limit(1)).filter("column = 'n'").first().std == 0.0
    assert {r.null_percent for r in profile.profile_columns(df.limit(0)).collect()} == {0.0}
    assert {(r.value, r.n) for r in profile.small_counts(profile.text_counts(df)).collect()} == {("a", 2), (None, 1)}
    assert "\"column\":\"n\"" in profile.document(df, "t").first().profile
    assert [(r.column, r.kind) for r in extraction_advice(spark.createDataFrame([("1 kg", "x"), ("b", "y")], "a string, b string")).orderBy("column").collect()] == [("a", "integer"), ("b", None)]


def test_medians(spark):
    import random
    import statistics

    rng = random.Random(8)
    a = [rng.gauss(0, 1) for _ in range(4001)]
    b = [rng.randrange(5) for _ in range(4001)]
    rows = [(x, y if k % 2 else None, None, 7) for k, (x, y) in enumerate(zip(a, b))]
    got = profile.medians(spark.createDataFrame(rows, "a double, b int, c double, d int"), ["a", "b", "c", "d"])
    assert got == {"a": statistics.median(a), "b": statistics.median([r[1] for r in rows if r[1] is not None]), "c": None, "d": 7.0}
    assert profile.medians(spark.createDataFrame([(1.0,), (4.0,)], "x double"), ["x"]) == {"x": 2.5}
    assert profile.medians(spark.createDataFrame([], "x double"), ["x"]) == {"x": None}


# ---------------------------------------------------------------- text tables


def parsed(spark, text, parity=False):
    rows, meta = texttable.parse_tables(spark.createDataFrame([(1, text)], "id int, text string"), parity)
    return [r.cells for r in rows.orderBy("row_no").collect()], meta.collect()


def test_plain_and_comma(spark):
    rows, meta = parsed(spark, "name,age\nann,31\nbob,7")
    assert rows == [["name", "age"], ["ann", "31"], ["bob", "7"]] and meta[0].has_headers and meta[0].layout == "plain" and meta[0].separator == ","
    assert parsed(spark, "one cell")[1] == [] and parsed(spark, "  \n")[1] == [] and parsed(spark, None)[1] == []
    rows, meta = parsed(spark, "a\nb")
    assert rows == [["a"], ["b"]] and meta[0].separator is None
    assert parsed(spark, "a\tb")[1][0].layout == "single"


def test_footnotes_and_title(spark):
    rows, meta = parsed(spark, "List of things\nCountry\tCity\tPeople\nFrance[a]\tParis\t67,391,582\nSpain\tMadrid[12]\t−5[b]")
    assert rows == [["Country", "City", "People"], ["France", "Paris", "67,391,582"], ["Spain", "Madrid[12]", "-5"]]
    assert meta[0].layout == "messy" and meta[0].has_headers and meta[0].is_messy


SPLIT = "Rank\tCity\tProvince\tA\tB\tC\n" + "\n".join(f"{k}\nTown{k}\tP{k}\t{k}0\t{k}1\t{k}2" for k in range(1, 6))


def test_split_rows_keep_their_ranks(spark):
    rows, meta = parsed(spark, SPLIT)
    assert meta[0].layout == "split" and rows[1] == ["1", "Town1", "P1", "10", "11", "12"] and len(rows) == 6
    rows, meta = parsed(spark, SPLIT, parity=True)
    assert meta[0].layout != "split" and rows[1][0] == "Town1"


def test_leading_tab(spark):
    text = "\tname\tage\n1\tann\t31"
    assert parsed(spark, text)[0][0] == ["", "name", "age"] and parsed(spark, text, parity=True)[0][0][0] == "name"


def test_multiline_headers(spark):
    rows, meta = parsed(spark, "Rank\tAnimal\tMass\t\n\t\t(m)\n\t\t\tOrigin[a]\n\tfoo\n1\tcat\t5\tasia\n2\tdog\t7\teurope")
    assert meta[0].layout == "multiline" and rows == [["Rank", "Animal", "Mass (m)", "Origin"], ["1", "cat", "5", "asia"], ["2", "dog", "7", "europe"]]


def test_spanning_headers_and_records(spark):
    top = "Title\tDate\tDirector\tWriter(s)\tProducer\tMusic\nStory\tScreenplay\n"
    rows, meta = parsed(spark, top + "Klaus\tMay 1, 2019\tAnn\tBob\nCo-director: Cy\t\nOther\tJune 2, 2020\tDee\tEve")
    assert meta[0].layout == "spanning" and rows[0] == ["Title", "Date", "Director", "Writer(s) - Story", "Writer(s) - Screenplay", "Producer"]
    assert rows[1:] == [["Klaus", "May 1, 2019", "Ann", "Bob", "Co-director: Cy", ""], ["Other", "June 2, 2020", "Dee", "Eve", "", ""]]
    ranked = top + "1\tA\t10\t20\n2\tB\t11\t21"
    assert len(parsed(spark, ranked)[0]) == 3 and len(parsed(spark, ranked, parity=True)[0]) == 1
    no_span = "A\tB\tC\tD\tE\tF\nx\ty\nKlaus\tMay 1\tAnn\tBob"
    assert parsed(spark, no_span)[0][0] == ["A", "B", "C", "x", "y", "D"]


def test_complex_headers(spark):
    rows, meta = parsed(spark, "City\tState\tPop.\tArea\tPlace\n\tmi2\tkm2\t\nx\t\t\t\t\nNew York\tNY\t8\t300\t40°N 74°W\nLos Angeles\tCA\t4\t469\t34°N 118°W")
    assert meta[0].layout == "complex" and rows[0] == ["City", "State", "Pop_", "Area", "Place"] and rows[-1][0] == "Los Angeles"


def test_long_cells_and_preview(spark):
    texts = spark.createDataFrame([(1, "a\ta\t\n1,000\tx\t\n2%\t\tz"), (2, "k,v\n5,a very long value indeed")], "id int, text string")
    rows, meta = texttable.parse_tables(texts)
    cells = {(r.id, r.row_no, r.col_no): r for r in texttable.long_cells(rows, meta.withColumn("has_headers", F.lit(True))).collect()}
    assert [cells[1, 0, k].header for k in range(3)] == ["a", "a_2", "Column_3"]
    assert cells[1, 0, 0].num == 1000.0 and cells[1, 1, 0].num == 2.0 and cells[1, 1, 1].cell is None
    assert any("a very lo..." in r.line for r in texttable.preview(rows).collect())
    wide = texttable.to_frame(texttable.long_cells(rows, meta.withColumn("has_headers", F.lit(True))), 2, ["k", "v"])
    assert wide.first().v == "a very long value indeed"


def test_neighbours_of_many_matches_are_found_in_many_tasks(spark):
    from gridloom.operators import search

    rows = [k for k in range(1, 9001) if k % 3]
    hits = spark.createDataFrame([(k, 2) for k in reversed(rows)], "row long, col int")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = search.with_neighbours(hits).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(key, before)
    assert {r.row: (r.next_row, r.previous_row) for r in got} == {k: (rows[(n + 1) % len(rows)], rows[n - 1]) for n, k in enumerate(rows)}
    assert len(got) == len(rows) and len({r.task for r in got}) > 1
    assert search.with_neighbours(hits.limit(0)).count() == 0


def test_split_rows_are_read_from_texts_of_bounded_size(spark, monkeypatch):
    from gridloom.plans import text_queries

    texts, parse = [], texttable.parse_tables
    monkeypatch.setattr(text_queries.texttable, "parse_tables", lambda df: texts.append(df) or parse(df))
    got = text_queries.split_rows_round_trip(spark, "/root/testdata/sf0.1").collect()
    want = spark.read.parquet("/root/testdata/sf0.1/supplier.parquet").collect()
    assert sorted((r.rank, r.name, r.nation) for r in got) == sorted((str(r.s_suppkey), r.s_name, str(r.s_nationkey)) for r in want)
    lines = [r.text.count("\n") for r in texts[0].collect()]
    assert len(lines) == -(-len(want) // 100) and max(lines) <= 200


def test_typed_edits_convert_only_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, 1.5, 15, "x"), (2, 2.75, 27, "y")], "_row long, f double, i long, t string")
    of = lambda column, value: [tuple(r) for r in edit.edit_cell(rows.select("_row", column), 1, column, value, convert_column=True).orderBy("_row").collect()]
    assert of("f", "5") == [(1, 5.0), (2, 2.75)] and of("i", "1") == [(1, 1), (2, 27)] and of("i", "2.5") == [(1, 2.5), (2, 27.0)]
    assert of("i", "word") == [(1, "word"), (2, "27")] and of("t", "7") == [(1, "7"), (2, "y")]


def test_names_with_tabs_and_breaks_are_refused():
    assert all(edit.name_error(f"a{c}b", []) for c in "\t\n\r\f\v .") and edit.name_error("a_b", []) is None


def test_a_failed_swap_keeps_the_source(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/kept.parquet"
    files.save(spark.range(5), path)
    blocked = tmp_path / "gone"
    with pytest.raises(OSError):
        files.save_over_source(spark.range(3), f"{blocked}/missing.parquet")
    files.save_over_source(files.load(spark, path).filter("id > 1"), path)
    assert sorted(r.id for r in files.load(spark, path).collect()) == [2, 3, 4]


def test_settled_tables_are_deleted(spark):
    import os

    from gridloom import scratch

    held = scratch.settle(spark.range(3), "gone")
    folder = held.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.exists(folder) and scratch.clean(spark) > 0 and not os.path.exists(folder)


def test_untracked_steps_run_nothing(spark):
    stage = stages.Stage("s", spark.range(3))
    out = stage.apply(lambda df: df.withColumn("bad", F.raise_error(F.lit("ran"))), track=False)
    assert out.columns == ["id", "bad"] and stage.steps[0].input_fp == ""
