"""JSON files that aren't one object a line, in parts (S06): arrays on one line or many, objects over several lines, several of either.

A file is cut into byte ranges. A first pass tells what each range does to the four states that it may begin in (inside a string or not, behind
an odd run of backslashes or not): the state behind it and the change of depth. The states of a file's ranges follow one another in a group
of one row a range. In a second pass each range puts out the values that begin in it, reading on where the last one ends later. Values are
written as lines, which Spark's own reader takes from there: types, corrupt records and pushed filters are its work.

The first byte decides what a file holds: the elements of its arrays are rows, or else its objects are. An element that is no object, and a
value that the file's end cuts off, are rows that the reader calls corrupt; what stands between objects is not looked at. UTF-8 only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.scratch import new_path

#: Bytes of a range, of a task's ranges, and of what is read on for a value that ends in another range.
RANGE, TASK, MORE = 8 << 20, 128 << 20, 1 << 20
#: A first line longer than this is not asked whether it is an object.
HEAD = 1 << 20
STEP = np.zeros(256, np.int8)
STEP[[ord("{"), ord("[")]], STEP[[ord("}"), ord("]")]] = 1, -1
MARKS = STEP != 0
MARKS[ord(",")] = True
BLANK = b" \t\r\n"
BOM = b"\xef\xbb\xbf"
FLAT = bytes.maketrans(b"\r\n", b"  ")


def opened(path: str):
    """A path as Spark names it, for random access by Arrow's file systems."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def marks_of(block: np.ndarray, inside: int, odd: int) -> tuple[np.ndarray, int, int]:
    """Places of brackets and commas outside of strings, and the state behind the block."""
    place = np.arange(len(block), dtype=np.int32)
    other = np.maximum.accumulate(np.where(block == ord("\\"), np.int32(-1), place))  # the last byte so far that is no backslash
    quotes = np.flatnonzero(block == ord('"'))
    before = np.where(quotes > 0, other[quotes - 1], -1)
    run = quotes - 1 - before + odd * (before == -1)
    flips = np.zeros(len(block), np.int8)
    flips[quotes[run % 2 == 0]] = 1
    within = (np.cumsum(flips, dtype=np.int32) + inside) & 1
    end = len(block) - 1 - other[-1] + odd * (other[-1] == -1)
    return np.flatnonzero(MARKS[block] & (within == 0)), int(within[-1]), int(end % 2)


def summary(block: np.ndarray) -> list[list[int]]:
    """For the states (inside, odd) = 00, 01, 10, 11: [inside, odd, change of depth] behind the block."""
    found = []
    for inside in (0, 1):
        for odd in (0, 1):
            marks, within, left = marks_of(block, inside, odd)
            found.append([within, left, int(STEP[block[marks]].sum(dtype=np.int64))])
    return found


def values_of(source, start: int, end: int, length: int, state: tuple[int, int, int], arrays: bool) -> Iterator[bytes]:
    """The values that begin in bytes start to end of a file, in the state (inside, odd, depth) before them."""

    def bounds(block: np.ndarray, inside: int, odd: int, depth: int):
        marks, inside, odd = marks_of(block, inside, odd)
        sign = block[marks]
        level = depth + np.cumsum(STEP[sign], dtype=np.int64)
        if arrays:
            comma = (sign == ord(",")) & (level == 1)
            first, last = marks[comma | ((sign == ord("[")) & (level == 1))] + 1, marks[comma | ((sign == ord("]")) & (level == 0))]
        else:
            first, last = marks[(sign == ord("{")) & (level == 1)], marks[(sign == ord("}")) & (level == 0)] + 1
        return first, last, (inside, odd, int(level[-1]) if len(level) else depth)

    source.seek(start)
    text = source.read(end - start)
    first, last, state = bounds(np.frombuffer(text, np.uint8), *state)
    until = np.searchsorted(last, first, "left" if arrays else "right")
    for i, j in zip(first, until):
        if j < len(last):
            value = text[i : last[j]]
        else:  # it ends behind the range
            parts, at = [text[i:]], end
            while at < length:
                more = source.read(min(MORE, length - at))
                at += len(more)
                _, ends, state = bounds(np.frombuffer(more, np.uint8), *state)
                parts.append(more[: ends[0]] if len(ends) else more)
                if len(ends):
                    break
            value = b"".join(parts)
        value = value.translate(FLAT).strip(BLANK)
        if value:
            yield value


def is_lines(spark: SparkSession, path: str) -> bool | None:
    """Does the first line of each file hold a whole object? None where a file is not UTF-8. One short read a file, in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = []
            for name in batch.column("path").to_pylist():
                with opened(name) as source:
                    head = source.read(HEAD).removeprefix(BOM)
                line = head.lstrip(BLANK).partition(b"\n")[0]
                try:
                    kinds.append(2 if b"\0" in line[:4] else int(isinstance(json.loads(line), dict)))
                except ValueError:
                    kinds.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32())], ["kind"])

    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0").select("path")
    kinds = files.mapInArrow(run, "kind int").agg(F.min("kind").alias("least"), F.max("kind").alias("most")).first()
    return None if kinds.most == 2 else kinds.least is None or kinds.least == 1


def lines_of(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(value): a line for each element of the arrays, or each object, of the files at ``path``."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
                with opened(name) as source:
                    source.seek(start)
                    text = source.read(end - start)
                body = (text.removeprefix(BOM) if start == 0 else text).lstrip(BLANK)
                turns = summary(np.frombuffer(text, np.uint8))
                yield pa.RecordBatch.from_pylist([{"path": name, "start": start, "end": end, "begins": body[:1], "turns": turns}], schema)

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        arrays = next((b for b in rows["begins"] if len(b)), b"") == b"["
        states, state = [], (0, 0, 0)
        for turns in rows["turns"]:
            states.append(state)
            inside, odd, change = turns[2 * state[0] + state[1]]
            state = (int(inside), int(odd), state[2] + int(change))
        out = rows[["path", "start", "end"]].copy()
        out["length"], out["arrays"] = rows["end"].max(), arrays
        out[["inside", "odd", "depth"]] = states
        return out

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                held, weight = [], 0
                with opened(r["path"]) as source:
                    for value in values_of(source, r["start"], r["end"], r["length"], (r["inside"], r["odd"], r["depth"]), r["arrays"]):
                        held.append(value)
                        weight += len(value)
                        if weight > MORE:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).cast(pa.string())], ["value"])
                            held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).cast(pa.string())], ["value"])

    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("begins", pa.binary()), ("turns", pa.list_(pa.list_(pa.int64())))])
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    weight = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-weight // TASK))
    ranges = files.select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {size}L)")).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + size, "length").alias("end")).repartition(tasks)
    seen = ranges.mapInArrow(look, "path string, start bigint, end bigint, begins binary, turns array<array<bigint>>")
    known = seen.groupBy("path").applyInPandas(follow, "path string, start bigint, end bigint, length bigint, arrays boolean, inside int, odd int, depth bigint")
    return known.repartition(tasks).mapInArrow(put, "value string")


def read(spark: SparkSession, path: str, schema=None, size: int = RANGE) -> DataFrame:
    """The files at ``path`` as a table, through lines in the shared folder."""
    lines = new_path(spark, "json-lines")
    lines_of(spark, path, size).write.text(lines)
    return (spark.read.schema(schema) if schema is not None else spark.read).json(lines)
