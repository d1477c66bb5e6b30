"""As-of and range joins against plain loops, and how their rows are spread; observed fingerprints; versions of tables."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from gridloom import scratch
from gridloom.operators import frame, stages
from gridloom.sources.versions import VersionConflict, VersionedTable


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("parts", ["4", "13"])
def test_as_of_of_a_hot_key(spark, uncoalesced, parts):
    pick = random.Random(6)
    key = lambda: "hot" if pick.random() < 0.5 else pick.choice(["a", "b", None, "only left"])
    left = [(k, key(), pick.choice([None, *range(1000)])) for k in range(3000)]
    times = {"hot": sorted(pick.sample(range(1000), 300)), "a": [5, 990], "b": [], "only right": [1]}
    right = [(k, t, None if t % 17 == 0 else f"{k}{t}") for k, ts in times.items() for t in ts] + [(None, 3, "x"), ("hot", None, "y")]
    a = spark.createDataFrame(left, "id long, k string, t int").repartition(3)
    b = spark.createDataFrame(right, "k string, t int, v string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        sizes = [r["count"] for r in frame.as_of_layout(a, b, "k", "t", "v").groupBy("__part").count().collect()]
        got = {r.id: (r.k, r.t, r.v) for r in frame.as_of(a, b, "k", "t", "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) == int(parts) and max(sizes) < 2.5 * sum(sizes) / len(sizes)
    want = {}
    for i, k, t in left:
        held = times.get(k, []) if t is not None else []
        at = bisect.bisect_right(held, t) if t is not None else 0
        want[i] = (k, t, None if not at or held[at - 1] % 17 == 0 else f"{k}{held[at - 1]}")
    assert got == want


def test_range_join_of_any_length(spark):
    pick = random.Random(9)
    spans = [(k, low, low + pick.choice([0, 1, 7, 100, 10**6, 2**40, -3])) for k, low in enumerate(pick.choice([-(10**6), -5, 0, 3, 10**5]) + pick.randrange(1000) for _ in range(200))]
    spans += [(900, None, 5), (901, 5, None), (902, -(2**63), 2**63 - 1)]
    points = [(k, pick.choice([None, -(2**63), 2**63 - 1, *range(-1200, 1200), 10**5 + 30])) for k in range(300)]
    a, b = spark.createDataFrame(points, "p long, x long"), spark.createDataFrame(spans, "s long, lo long, hi long")
    got = sorted((r.p, r.s) for r in frame.range_join(a, b, "x", "lo", "hi").collect())
    assert got == sorted((p, s) for p, x in points for s, lo, hi in spans if x is not None and lo is not None and hi is not None and lo <= x <= hi)
    assert frame.range_join(a, b.limit(0), "x", "lo", "hi").count() == 0
    # two rows a span at most
    expanded = frame.range_join(a, b, "x", "lo", "hi")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in expanded


def test_fingerprints_come_with_one_run(spark):
    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    source = spark.range(100).mapInArrow(counted, "id long")
    stage = stages.Stage("s", source)
    frames = [source]
    for k in range(5):
        frames.append(stage.apply(lambda df, k=k: df.filter(F.col("id") != k).withColumn("id", F.col("id") + 1000 * (k == 4))))
    assert ran.value == 0 and {r.input_fp for r in stage.steps} == {""}
    found = stage.track()
    assert ran.value == 100 and [r.input_rows for r in stage.steps] == [100, 99, 98, 97, 96]
    assert found == [stages.fingerprint(df) for df in frames[:-1]] and stage.track() == found
    assert stage.branches == [] and len(set(found)) == 5


def test_fingerprints_of_steps_that_stop_early(spark):
    stage = stages.Stage("s", spark.range(0, 5000, 1, 8))
    stage.apply(lambda df: df.withColumn("x", F.col("id") % 7))
    stage.apply(lambda df: df.limit(3))
    stage.apply(lambda df: df.join(df.select("id"), "id"))
    stage.apply(lambda df: df.groupBy("x").count())
    stage.track()
    assert [r.input_rows for r in stage.steps] == [5000, 5000, 3, 3]


def test_a_callers_own_write_pays(spark):
    book = stages.Workbook(spark)
    book.add("s", spark.range(50))
    book.apply("s", "SELECT id * 2 AS id FROM {df}")
    path = scratch.new_path(spark, "test-track")
    (found,) = book.get("s").track(lambda df: df.write.parquet(path))
    assert found == stages.fingerprint(spark.range(50)) and spark.read.parquet(path).count() == 50
    book.branch("s", "t")
    book.apply("t", "SELECT id + 1 AS id FROM {df}")
    rows = {(r.sheet, r.step): r.input_fp for r in book.lineage().collect()}
    assert rows[("t", 1)] == rows[("s", 1)] == found and rows[("t", 2)] == stages.fingerprint(spark.range(0, 100, 2))


def test_versions_touch_only_files_that_are_hit(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).cast("int").alias("d"), F.lit("é").alias("t"))
    table = VersionedTable.create(df.repartitionByRange(10, "id"), scratch.new_path(spark, "test-versions"))
    before = table.files()
    assert len(before) == 10
    assert table.delete(F.col("id").between(250, 260)) == 1
    after = table.files()
    assert len(set(before) & set(after)) == 9 and table.read().count() == 989 and table.read(0).count() == 1000
    assert table.update("t", F.lit("new"), F.col("id") >= 980) == 2 and len(set(after) & set(table.files())) == 9
    assert table.read().filter("t = 'new'").count() == 20
    patches = spark.createDataFrame([(5, "d", "77", 1), (5, "d", "78", 2), (5, "t", None, 1), (900, "t", "p", 1), (255, "t", "gone", 1)], "id long, column string, value string, seq int")
    kept = table.files()
    table.patch(patches, "id")
    assert len(set(kept) & set(table.files())) == 8
    rows = {r.id: (r.d, r.t) for r in table.read().filter("id in (5, 6, 900)").collect()}
    assert rows == {5: (78, None), 6: (6, "é"), 900: (0, "p")}
    # nothing hit, nothing written
    assert table.delete(F.col("id") < 0) == 3 and table.versions() == [0, 1, 2, 3]
    assert table.delete(F.lit(None).cast("boolean")) == 3
    table.append(spark.createDataFrame([(1, "x", 5000)], "d int, t string, id long"))
    assert table.read().count() == 990
    assert table.vacuum() > 0 and table.versions() == [4] and table.read().count() == 990


def test_versions_that_fail_leave_the_table(spark):
    table = VersionedTable.create(spark.range(20).select("id", F.lit(1).alias("n")), scratch.new_path(spark, "test-versions"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        table.patch(spark.createDataFrame([(1, "n", "no number", 1)], "id long, column string, value string, seq int"), "id")
    with pytest.raises(ValueError, match="No such columns"):
        table.patch(spark.createDataFrame([(1, "m", "1", 1)], "id long, column string, value string, seq int"), "id")
    with pytest.raises(VersionConflict):
        table._commit(0, [], table.read().schema)
    with pytest.raises(ValueError, match="No version"):
        table.read(7)
    assert table.versions() == [0] and table.read().count() == 20
    assert table.delete(F.lit(True)) == 1 and table.read().count() == 0 and table.read().columns == ["id", "n"]
    assert table.delete(F.lit(True)) == 1
