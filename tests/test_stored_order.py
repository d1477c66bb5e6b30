"""Stored orders: which ranges a look-up opens, and its rows against a plain sort."""

import os
import uuid

import pytest

from gridloom import scratch
from gridloom.operators import order


@pytest.fixture(scope="module")
def stored(spark):
    rows = [(k, None if k % 50 == 0 else float((k * 7919) % 1000), f"t{k}") for k in range(2000)]
    df = spark.createDataFrame(rows, "k long, v double, t string").repartition(5)
    keys = [("v", True), ("k", True)]
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    return order.store(df, keys, scratch.new_path(spark, "test-order"), 100), want


def parts(df):
    return {path.split("__part=")[1].split("/")[0] for path in df.inputFiles() if "__part=" in path}


def test_pages_open_their_ranges(spark, stored):
    one, want = stored
    assert one.total == 2000 and one.index.count() >= 15
    page = one.page(1000, 100)
    assert [tuple(r) for r in page.collect()] == [(n + 1, *want[n]) for n in range(949, 1049)]
    assert 1 <= len(parts(page)) <= 4
    for first, last in ((1, 1), (2000, 2000), (-5, 3), (1999, 5000), (300, 299), (5000, 6000)):
        got = one.between(first, last)
        assert sorted(tuple(r) for r in got.collect()) == [(n, *want[n - 1]) for n in range(max(first, 1), min(last, 2000) + 1)]
        assert len(parts(got)) <= 2
    assert sorted(tuple(r) for r in one.rows().collect()) == [(n + 1, *w) for n, w in enumerate(want)]


def test_stretches_of_the_key_open_their_ranges(spark, stored):
    one, want = stored
    got = one.around(100.0, 120.0)
    assert sorted(tuple(r) for r in got.collect()) == [(n + 1, *w) for n, w in enumerate(want) if w[1] is not None and 100 <= w[1] <= 120]
    assert len(parts(got)) <= 3 and one.around(5000.0, 6000.0).count() == 0


def test_falling_keys_and_reopening(spark):
    df = spark.createDataFrame([(k, k % 7 if k % 3 else None) for k in range(300)], "k long, v int")
    path = scratch.new_path(spark, "test-order")
    keys = [("v", False), ("k", True)]
    order.store(df, keys, path, 40)
    again = order.open_order(spark, path, keys)
    want = sorted(((r.k, r.v) for r in df.collect()), key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    assert [tuple(r) for r in again.rows().orderBy("_row").collect()] == [(n + 1, *w) for n, w in enumerate(want)]
    got = again.around(2, 3)
    assert sorted(r.k for r in got.collect()) == sorted(k for k, v in want if v in (2, 3)) and len(parts(got)) < again.index.count()


def test_empty_and_broken(spark):
    path = scratch.new_path(spark, "test-order")
    one = order.store(spark.createDataFrame([], "k long"), [("k", True)], path)
    assert one.total == 0 and one.page(1).count() == 0 and one.page(1).columns == ["_row", "k"]
    broken = f"{scratch.shared_folder(spark)}/{uuid.uuid4().hex}"
    spark.range(3).write.parquet(f"{broken}/rows")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        order.open_order(spark, broken, [("id", True)])
    assert os.path.isdir(broken.removeprefix("file://"))
