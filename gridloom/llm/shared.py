"""What several operators need: text blocks, word and shingle hashes."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from gridloom.scratch import settle, shared_folder

__all__ = ["batch_rows", "blocks", "mix", "offsets_of", "settle", "shared_folder", "shingle_hashes", "text_bytes", "word_hashes"]

#: Bytes of text that one numpy step holds at once in a task.
BLOCK_BYTES = 1 << 20


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of a batch that goes to Python, for the jobs run inside: long texts make batches of Spark's default large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``limit`` bytes in ``column``, or of one longer row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.diff(offsets_of(batch.column(column)))
        starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // limit, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def offsets_of(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind one another, and len+1 offsets into them. No nulls are expected."""
    offsets = offsets_of(array)
    data = array.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[k] = np.multiply.accumulate(table)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all others (in place)."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words between ASCII spaces, and the number of each word's text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:] & ~first[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of ``size`` words and the number of each one's text.

    A text of fewer words, but at least one, has one shingle of all its words; a text without words has none.
    """
    words, owner = word_hashes(data, offsets)
    n = len(words)
    if not n:
        return words, owner
    sums = np.zeros(n, np.uint64)
    factor = _BASE
    for k in range(min(size, n)):
        factor = factor * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D & (1 << 64) - 1
        same = owner[k:] == owner[: n - k]
        sums[: n - k] += np.where(same, words[k:] * np.uint64(factor | 1), np.uint64(0))
    whole = np.zeros(n, bool)
    whole[: n - size + 1] = owner[size - 1 :] == owner[: n - size + 1] if n >= size else False
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    start = np.diff(owner, prepend=-1) > 0
    keep = whole | (start & (counts[owner] < size))
    return mix(sums[keep]), owner[keep]
