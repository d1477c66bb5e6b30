"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

The statistics come from the whole text. The random features approximate a Gaussian kernel over the standardised statistics. Every
partition of the training rows sums its normal equations; the sums are added and solved once. Scores of labelled rows kept apart from the
training fit the isotonic curve that turns a raw score into the probability of label 1.

Null texts count as empty and are scored too. Labels of a doc_id that comes twice are averaged; null labels are left out. Without labels
every score is 0.5, and an empty table has none. Repeated rows are scored each; of those with one doc_id one is learnt from. Columns but
doc_id and text, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.points import classes, points
from gridloom.llm.shared import blocks, mix, settle, text_bytes, word_hashes

STATISTICS = (
    "chars", "letters", "upper", "digits", "spaces", "breaks", "stops", "bars", "shouts", "signs", "words", "word_length", "word_spread", "short_words", "distinct_words", "distinct_triples", "repeats", "marked_words", "capital_words",
)


@dataclass
class Settings:
    #: The classifier is fitted on about this many labelled rows at most, drawn by a hash of doc_id.
    sample: int = 100_000
    features: int = 256
    ridge: float = 1e-3
    #: Width of the kernel in standard deviations of the statistics.
    width: float = 4.0
    seed: int = 5
    parts: int = 8


def statistics(array: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text of a string array without nulls."""
    n = len(array)
    out = np.zeros((n, len(STATISTICS)))
    codes, starts = points(array.to_pylist())
    table = classes()
    total = lambda mask: np.add.reduceat(mask.astype(np.int64), starts).astype(float)
    is_in = lambda chars: np.isin(codes, np.array([ord(c) for c in chars], np.uint32))
    chars = np.diff(np.append(starts, len(codes))) - 1.0
    per = np.maximum(chars, 1)
    letter = table["letter"][codes]
    letters = total(letter)
    out[:, 0] = np.log1p(chars)
    out[:, 1] = letters / per
    out[:, 2] = total(table["upper"][codes]) / np.maximum(letters, 1)
    out[:, 3] = total(table["digit"][codes]) / per
    out[:, 4] = total(codes == 32) / per
    out[:, 5] = np.sqrt((total(codes == 10) - 1) / per)
    for k, signs in ((6, ".,;:?"), (7, "|"), (8, "!"), (9, "#$%&*~^@=<>{}[]\\_+")):
        out[:, k] = np.sqrt(total(is_in(signs)) / per)
    data, offsets = text_bytes(array)
    words, owner = word_hashes(data, offsets)
    if len(words):
        count = np.bincount(owner, minlength=n).astype(float)
        some = np.maximum(count, 1)
        out[:, 10] = np.log1p(count)
        blank = (codes == 32) | (codes == 10) | (codes == 9)
        out[:, 11] = np.log1p((chars - total(blank) + 1) / some)
        # lengths of words in code points
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        held = np.searchsorted(starts, begin, side="right") - 1
        length = (end - begin).astype(float)
        m = np.maximum(np.bincount(held, minlength=n), 1)
        mean = np.bincount(held, length, n) / m
        out[:, 12] = np.sqrt(np.maximum(np.bincount(held, length**2, n) / m - mean**2, 0)) / np.maximum(mean, 1)
        out[:, 13] = np.bincount(held, length <= 3, n) / m
        tail = codes[end - 1]
        odd = ~table["letter"][tail] & ~table["digit"][tail] & ~np.isin(tail, np.array([ord(c) for c in ".,;:?\"')"], np.uint32))
        out[:, 17] = np.bincount(held, odd, n) / m
        out[:, 18] = np.bincount(held, table["upper"][codes[begin]], n) / m
        mine = owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        distinct = lambda h, who: np.bincount(who[np.unique(h, return_index=True)[1]], minlength=n)
        out[:, 14] = np.log1p(distinct(mix(words ^ mine), owner)) / np.log1p(some)
        same = owner[2:] == owner[:-2]
        triples = mix(words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(0x10001) + words[2:] ^ mine[:-2])[same]
        three = np.bincount(owner[:-2][same], minlength=n)
        out[:, 15] = np.where(three > 0, (distinct(triples, owner[:-2][same]) if len(triples) else 0) / np.maximum(three, 1), 1)
        out[:, 16] = np.bincount(owner[1:], (words[1:] == words[:-1]) & (owner[1:] == owner[:-1]), n) / some
    return out


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.cos(z @ self.omega + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mostly the isotonic curve; a hundredth is the raw score itself, so that steps of the curve keep an order."""
        raw = self.raw(x)
        return np.clip(0.99 * np.interp(raw, self.knots, self.values) + 0.01 * np.clip(raw, 0, 1), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing least-squares curve, by pooling adjacent violators; blocks stand at their mean x."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, weight, sum of x
    for a, b in zip(x[order], y[order]):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    held = np.array(pools)
    return held[:, 2] / held[:, 1], held[:, 0] / held[:, 1]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            x = statistics(batch.column("text")).astype(np.float32)
            column = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, x array<float>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS)).astype(float) if len(column) else np.zeros((0, len(STATISTICS)))


def _summed(rows: DataFrame, partial) -> np.ndarray | None:
    """Sum over partitions of what ``partial(x, y)`` gives, an array of fixed size; one row a partition comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                part = partial(matrix(batch.column("x")), batch.column("y").to_numpy())
                held = part if held is None else held + part
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["sums"])

    found = [np.frombuffer(r["sums"]) for r in rows.mapInArrow(run, "sums binary").collect()]
    return sum(found) if found else None


def drawn(labels: DataFrame, learn: Column, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, y): labels where ``learn`` (of doc_id) holds, averaged by doc_id, about ``settings.sample`` of them and never twice as many."""
    y = labels.filter(learn & F.col("y").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("y").cast("double")).alias("y"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(settings.seed)), 1) / F.lit(2.0**63)
    share = min(1.0, settings.sample / max(y.count(), 1))
    return settle(y.filter(place <= share).limit(2 * settings.sample), "quality-labels")


def fit(stats: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Learn from the rows of (doc_id, x) that have one of the drawn ``labels`` (doc_id, y)."""
    rows = stats.join(F.broadcast(labels), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    drawn = settle(rows.select("x", "y", (F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(4)) == 0).alias("apart")).repartition(settings.parts), "quality-train")
    training = drawn.filter("not apart")
    d = len(STATISTICS)
    first = _summed(training, lambda x, y: np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)]))
    if first is None:
        return None
    n, mean = first[0], first[1 : d + 1] / first[0]
    spread = np.sqrt(np.maximum(first[d + 1 :] / n - mean**2, 0)) + 1e-6
    rng = np.random.default_rng(settings.seed)
    model = Model(mean, spread, rng.normal(0, 1 / settings.width, (d, settings.features)), rng.uniform(0, 2 * np.pi, settings.features), np.zeros(settings.features + 1), np.zeros(1), np.zeros(1))
    m = settings.features + 1

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.lift(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _summed(training, equations)
    model.weight = np.linalg.solve(sums[: m * m].reshape(m, m) + settings.ridge * n * np.eye(m), sums[m * m :])
    apart = drawn.filter("apart").toArrow()  # a quarter of the bounded sample
    held = apart.combine_chunks().to_batches()
    if held and held[0].num_rows:
        x, y = matrix(held[0].column("x")), held[0].column("y").to_numpy()
        model.knots, model.values = isotonic(model.raw(x), y)
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def fit_texts(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """As ``fit``, from (doc_id, text): statistics of the drawn rows alone. The labels are few enough to send to every task."""
    return fit(with_statistics(docs.join(F.broadcast(labels.select("doc_id")), "doc_id", "left_semi")), labels, settings)


def scored(stats: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) for (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(matrix(batch.column("x"))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(run, f"doc_id {kind}, score double")


def score_text(text: Column, model: Model | None) -> Column:
    """Score of a text column, for filters that must carry all other columns along."""

    @F.arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            batch = pa.RecordBatch.from_arrays([part], ["text"])
            found = [model.score(statistics(b.column("text"))) if model else np.full(b.num_rows, 0.5) for b in blocks(iter([batch]), "text")]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    return run(F.coalesce(text, F.lit("")))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    stats = settle(with_statistics(docs), "quality-stats")
    model = fit(stats, drawn(labels.select("doc_id", F.col("quality").alias("y")), ~held_out(), settings), settings)
    return scored(stats, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
