"""Packing along a space-filling curve.

A document's vector is the average of a hashed random projection over its token ids; its direction in four dimensions, quantised, gives
a Hilbert key. Documents are range-sorted by (key, doc_id) and their ids written one after another into sequences of ``length`` tokens,
cut wherever a sequence is full; so neighbours on the curve share sequences. The rest at a partition's end is cut into sequences whose
lengths are powers of two, which need no padding.

Null texts are empty: one end token. Repeated rows are packed each, rows without doc_id too. Long texts are packed whole. Columns but doc_id
and text, whatever their names, are not looked at. An empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import blocks, settle

DIMS, BITS = 4, 12
#: A space that no word follows: there the rule may cut otherwise.
_ODD_SPACE = re.compile(r" (?:\s|\Z)")
#: Entries that a worker remembers of words already encoded, each of some 200 bytes.
REMEMBERED = 600_000


@dataclass(frozen=True)
class Settings:
    #: Path of the tokenizer's vocabulary; None: ``byte_bpe_50k`` of the installed public tokenizers.
    vocabulary: str | None = None
    length: int = 2048
    end: int = 1
    #: Bytes of ids that a task sorts and packs; the number of ranges follows from them.
    range_bytes: int = 64 << 20


class Encoder:
    """Ids of texts as little-endian uint16 bytes: those that ``tokenizers`` gives with this vocabulary, made by ``tiktoken``.

    In this vocabulary's rule for cutting texts, a cut always stands before a space that a non-space follows, so a text can be encoded
    word by word and words be remembered. Texts with other runs of spaces, or with the special token's string, are encoded whole."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.special = "<|endoftext|>"
        self.coding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={self.special: 50256})
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("H", self.coding.encode_ordinary(text)).tobytes()

    def _one(self, text: str) -> bytes:
        if self.special in text or _ODD_SPACE.search(text) is not None:
            return array("H", self.coding.encode(text, allowed_special="all")).tobytes()
        known = self.known
        head, *words = text.split(" ")
        got = list(map(known.get, words))
        if None in got:
            for k, word in enumerate(words):
                if got[k] is None:
                    got[k] = known.get(word) or self._ids(" " + word)
                    if len(word) <= 64:
                        known[word] = got[k]
        return self._ids(head) + b"".join(got)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return [self._one(text) for text in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def projection() -> np.ndarray:
    return np.random.default_rng(3).standard_normal((1 << 16, DIMS)).astype(np.float32)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of rows of integer coordinates below 2**bits: axes are turned and swapped from the top bit down,
    then Gray-coded, and their bits interleaved."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for k in range(n):
            high = (x[k] & q) > 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[k]) & low)
            x[0] ^= np.where(high, low, swap)
            x[k] ^= swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        turn ^= np.where((x[n - 1] & q) > 0, q - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            key = (key << one) | ((x[k] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def encoded(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, key, ids) for each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table = encoder(settings.vocabulary), projection()
        end = np.array([settings.end], "<u2").tobytes()
        for batch in blocks(batches, "text", 1 << 22):
            ids = [x + end for x in encode(batch.column("text").to_pylist())]
            lengths = np.array([len(x) // 2 for x in ids])
            vectors = np.add.reduceat(table[np.frombuffer(b"".join(ids), "<u2")], np.cumsum(lengths) - lengths, axis=0)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            cells = np.clip((vectors + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hilbert(cells)), pa.array(ids, pa.binary())], ["doc_id", "key", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, key bigint, ids binary")


def packed(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pieces of each partition of (doc_id, ids), in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        open_, filled, rows = [], 0, []  # pieces of the open sequence: (doc_id, start, ids, doc_tokens)

        def close(limit: int) -> None:
            """Write the open pieces' first ``limit`` tokens as one sequence; what is left stays open."""
            nonlocal open_, filled, sequence
            offset, left = 0, []
            for doc, start, ids, total in open_:
                take = min(len(ids), limit - offset)
                if take:
                    rows.append((doc, start, take, zlib.crc32(ids[:take].astype("<u4").tobytes()), total, sequence, offset))
                    offset += take
                if take < len(ids):
                    left.append((doc, start + take, ids[take:], total))
            open_, filled, sequence = left, filled - offset, sequence + 1

        def batch_of(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k or kind) for c, k in zip(columns, kinds)], names)

        kind = None
        for batch in batches:
            kind = batch.column("doc_id").type
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(ids.as_buffer(), "<u2")
                open_.append((doc, 0, ids, len(ids)))
                filled += len(ids)
                while filled >= settings.length:
                    close(settings.length)
            if rows:
                yield batch_of(kind)
        while filled:
            close(1 << (filled.bit_length() - 1))
        if rows:
            yield batch_of(kind)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece of a document.

    The ids are written once to the shared folder, so that finding the ranges doesn't encode again, with a number for each row; it breaks
    ties of key and doc_id, so copies spread over ranges even where they share a doc_id or have none."""
    ids = settle(encoded(docs, settings).withColumn("row", F.monotonically_increasing_id()), "packing-ids")
    size = ids.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    parts = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // settings.range_bytes))
    return packed(laid_out(ids, parts), settings)


def laid_out(ids: DataFrame, parts: int) -> DataFrame:
    """(doc_id, ids) in the order of (key, doc_id, row), in ``parts`` ranges."""
    return ids.repartitionByRange(parts, "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row").select("doc_id", "ids")
