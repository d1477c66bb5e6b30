"""Large files in parts: JSON that isn't one object a line, Arrow files of many batches."""

import io
import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.scratch import clean
from gridloom.sources import arrow_ipc, files, json_parts

OBJECTS = st.lists(st.dictionaries(st.text(max_size=5), st.recursive(st.none() | st.booleans() | st.integers() | st.text('a"\\{}[],: é', max_size=9), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text('"\\]}', max_size=3), x, max_size=3), max_leaves=8), max_size=3), max_size=8)


def cut_values(data, size, arrays):
    """All values of a text by its ranges, states carried as the job does it."""
    state, found = (0, 0, 0), []
    for start in range(0, len(data), size):
        end = min(start + size, len(data))
        found += json_parts.values_of(io.BytesIO(data), start, end, len(data), state, arrays)
        inside, odd, change = json_parts.summary(np.frombuffer(data[start:end], np.uint8))[2 * state[0] + state[1]]
        state = (inside, odd, state[2] + change)
    return found


@settings(deadline=None)
@given(OBJECTS, st.integers(1, 40), st.booleans(), st.booleans(), st.sampled_from([None, 1]), st.booleans())
def test_ranges_of_any_size_give_all_values(rows, size, arrays, plain, indent, twice):
    text = json.dumps(rows, ensure_ascii=plain, indent=indent) if arrays else "\n".join(json.dumps(r, ensure_ascii=plain, indent=indent) for r in rows)
    data = ((text + "\n" + text) if twice else text).encode()
    assert [json.loads(v) for v in cut_values(data, size, arrays)] == rows * (2 if twice else 1)


def test_json_arrays_of_many_ranges(spark, tmp_path):
    rng = random.Random(3)
    rows = [{"id": k, "text": "".join(rng.choice('ab"\\{}[],\n') for _ in range(rng.randrange(60))), "deep": {"x": [k, [k]], "y": {"z": None}}} for k in range(3000)]
    os.mkdir(tmp_path / "all.json")
    (tmp_path / "all.json" / "one.json").write_text(json.dumps(rows[:2000]))
    (tmp_path / "all.json" / "two.json").write_text(json.dumps(rows[2000:2500], indent=2) + "\n" + json.dumps(rows[2500:]))
    got = json_parts.read(spark, f"file://{tmp_path}/all.json", size=5000)
    assert {r.id: r.text for r in got.collect()} == {r["id"]: r["text"] for r in rows}
    # by one range a file too, and with a schema and chosen columns
    assert files.load(spark, f"file://{tmp_path}/all.json").count() == 3000
    some = files.load(spark, f"file://{tmp_path}/all.json", schema="text string, id bigint", columns=["id"])
    assert some.columns == ["id"] and some.count() == 3000


def test_json_forms(spark, tmp_path):
    def rows(name, text):
        (tmp_path / name).write_bytes(text)
        return [r.asDict() for r in files.load(spark, f"file://{tmp_path}/{name}").collect()]

    assert rows("lines.json", b'{"a": 1}\n{"a": 2}\n') == [{"a": 1}, {"a": 2}]
    assert rows("pretty.json", b'\xef\xbb\xbf\n{\n "a": 1\n}\n{\n "a": 2}') == [{"a": 1}, {"a": 2}]
    assert rows("marked.json", b'\xef\xbb\xbf [{"a": 1},\r\n{"a": 2}]') == [{"a": 1}, {"a": 2}]
    assert rows("wide.json", '[{"a": 1}]'.encode("utf-16")) == [{"a": 1}]
    assert rows("none.json", b"[]") == [] and rows("blank.json", b" \n") == [] and rows("empty.json", b"") == []
    # an element that is no object and one that is cut off are corrupt rows, not lost ones
    odd = rows("odd.json", b'[{"a": 1}, 5, {"a": 2}, {"a": 3')
    assert sorted(r["a"] for r in odd if r["a"] is not None) == [1, 2] and sorted(r["_corrupt_record"] or "" for r in odd) == ["", "", "5", '{"a": 3']
    clean(spark)


def _write(path, rows, step):
    table = pa.table({"id": range(rows), "name": [f"n{k}" for k in range(rows)], "x": [k / 2 for k in range(rows)]})
    with pa.OSFile(str(path), "wb") as sink, pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table, step)


def test_one_arrow_file_is_read_by_several_tasks(spark, tmp_path):
    _write(tmp_path / "many.arrow", 10_000, 100)
    arrow_ipc.register(spark)
    got = spark.read.format(arrow_ipc.NAME).option("splitBytes", 20_000).load(f"file://{tmp_path}/many.arrow")
    assert got.rdd.getNumPartitions() > 5 and got.count() == 10_000 and got.agg({"id": "sum"}).first()[0] == 9999 * 5000
    # small files share a task; columns come in the order asked for
    os.mkdir(tmp_path / "small.arrow")
    for k in range(5):
        _write(tmp_path / "small.arrow" / f"{k}.arrow", 10, 4)
    some = files.load(spark, f"file://{tmp_path}/small.arrow", columns=["x", "id"])
    assert some.rdd.getNumPartitions() == 1 and some.columns == ["x", "id"] and sorted(r.id for r in some.collect()) == sorted(list(range(10)) * 5)
    with pytest.raises(ValueError, match="has no column"):
        arrow_ipc._reader(str(tmp_path), str(tmp_path / "many.arrow"), ["none"])


def test_an_overwrite_shows_all_or_nothing(tmp_path):
    path, batch = str(tmp_path / "t.arrow"), lambda *ids: pa.record_batch({"id": list(ids)})

    def ids(reader):
        return sorted(i for part in reader.partitions() for b in reader.read(part) for i in b.column("id").to_pylist())

    def read():
        return arrow_ipc._Read(path, ["id"], 1 << 20)

    first = arrow_ipc._Write(path, True)
    first.commit([first.write(iter([batch(1, 2)])), first.write(iter([]))])
    begun = read()
    planned = begun.partitions()
    second = arrow_ipc._Write(path, True)
    done = [second.write(iter([batch(3)])), second.write(iter([batch(4)]))]
    second.write(iter([batch(99)]))  # a task that Spark doesn't count
    assert ids(read()) == [1, 2]
    second.commit(done)
    assert ids(read()) == [3, 4]
    assert sorted(i for part in planned for b in begun.read(part) for i in b.column("id").to_pylist()) == [1, 2]
    more = arrow_ipc._Write(path, False)
    more.commit([more.write(iter([batch(5)]))])
    assert ids(read()) == [3, 4, 5]
    failed = arrow_ipc._Write(path, True)
    failed.write(iter([batch(6)]))
    failed.abort([])
    assert ids(read()) == [3, 4, 5]
    third = arrow_ipc._Write(path, True)
    third.commit([third.write(iter([batch(7)]))])
    assert ids(read()) == [7] and not (tmp_path / "t.arrow" / first.folder).exists()
