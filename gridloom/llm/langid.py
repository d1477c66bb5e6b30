"""Language ID: averaged hashed subword embeddings under a linear softmax.

Subwords are runs of 1 to 4 letters with the word's ends; each falls into one of ``BUCKETS`` buckets with an embedding. A text's vector
is the average over all its subwords, counted in the whole text. Embeddings and softmax are trained by stochastic gradient descent in
numpy on a bounded sample of labelled texts, then a temperature is fitted on texts kept apart, and the least score is chosen at which the
wanted share of those is right; texts below it are marked as rejected.

A null text, or one without letters, is ``und`` with score 0. With no labelled text, as in an empty table, every prediction is ``und``.
Equal scores go to the language that sorts first; repeated rows are predicted each and drawn once; texts are read whole, long ones piece by
piece; columns but doc_id, text and lang, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.points import classes, points
from gridloom.llm.shared import blocks

BUCKETS = 1 << 15
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@dataclass
class Settings:
    #: The classifier is fitted on at most this many labelled texts, as many of each language as there are, drawn by a hash of doc_id and
    #: text; all are predicted.
    sample: int = 2400
    dim: int = 8
    epochs: int = 6
    rate: float = 0.3
    scale: float = 40.0
    keep_right: float = 0.99
    seed: int = 11


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray  # bucket -> embedding
    weight: np.ndarray  # of the softmax, for an averaged embedding as it is
    bias: np.ndarray
    temperature: float
    least: float


#: Characters of a text that are held at once; a piece also sees the next ones that its last subwords reach.
PIECE, REACH = 1 << 18, 3
#: Scores of texts times languages that are held at once.
LOGITS = 1 << 20


def pieces(texts: list[str]) -> tuple[list[tuple[list[str], list[int]]], int]:
    """Texts in lower case as groups of pieces of about PIECE characters, with the number of each piece's text; and how many texts there are."""
    groups, now, who, held = [], [], [], 0
    for k, text in enumerate(t.lower() for t in texts):
        for at in range(0, max(len(text), 1), PIECE):
            if held > PIECE:
                groups.append((now, who))
                now, who, held = [], [], 0
            now.append(text[at : at + PIECE + REACH])
            who.append(k)
            held += len(now[-1])
    return [*groups, (now, who)], len(texts)


def subwords(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For each length (buckets, is it a subword) at every position, starts of the pieces, letters of each piece. Subwords that begin in what a
    piece only sees are none of its own."""
    codes, starts = points(texts)
    letter = classes()["letter"][codes]
    mine = np.ones(len(codes), bool)
    for a, text in zip(starts, texts):
        mine[a + min(len(text), PIECE) : a + len(text) + 1] = False  # the line break behind a text begins no subword with the next one
    x = np.where(letter, codes, 32).astype(np.uint32)
    n = len(x)
    out = []
    for size in range(1, 5):
        h = np.zeros(n, np.uint32)
        good = letter.copy() if size == 1 else np.ones(n, bool)
        for k in range(size):
            h[: n - k] += x[k:] * _FACTORS[k]
            if 0 < k < size - 1:
                good[: n - k] &= letter[k:]
                good[n - k :] = False
        if size == 2:
            good[:-1] = letter[:-1] | letter[1:]
        good[n - size + 1 :] &= size == 1
        good &= mine
        h = (h * np.uint32(0x9E3779B1 + 2 * size)) >> np.uint32(17)
        out.append((h, good))
    return out, starts, np.add.reduceat((letter & mine).astype(np.int64), starts)


def count_subwords(docs: DataFrame) -> DataFrame:
    """(lang, ids, counts) of each row of (lang, text): little-endian uint16 buckets and uint32 counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            groups, n = pieces(batch.column("text").to_pylist())
            ids, counts = [np.zeros(0, "<u2")] * n, [np.zeros(0, "<u4")] * n
            for texts, who in groups:
                found, starts, _ = subwords(texts)
                for k, a, b in zip(who, starts, np.append(starts[1:], len(found[0][0]))):
                    bins = np.bincount(np.concatenate([h[a:b][good[a:b]] for h, good in found]), minlength=BUCKETS)
                    bins[ids[k]] += counts[k]
                    ids[k] = np.flatnonzero(bins).astype("<u2")
                    counts[k] = bins[ids[k]].astype("<u4")
            ids, counts = [x.tobytes() for x in ids], [x.tobytes() for x in counts]
            yield pa.RecordBatch.from_arrays([batch.column("lang").cast(pa.string()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["lang", "ids", "counts"])

    return docs.mapInArrow(run, "lang string, ids binary, counts binary")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list, settings: Settings) -> Model | None:
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    rng = np.random.default_rng(settings.seed)
    data = []
    for r in rows:
        ids, counts = np.frombuffer(r["ids"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.float32)
        if len(ids):
            data.append((ids, counts / counts.sum(), langs.index(r["lang"])))
    order = rng.permutation(len(data))
    apart = max(1, len(data) // 5) if len(data) > 10 else 0
    held, fit = order[:apart], order[apart:]
    embed = rng.uniform(-1, 1, (BUCKETS, settings.dim)).astype(np.float32) / settings.dim
    weight, bias = np.zeros((settings.dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(settings.epochs):
        rate = np.float32(settings.rate * (1 - epoch / settings.epochs))
        for k in rng.permutation(fit):
            ids, share, want = data[k]
            mine = embed[ids]
            v = settings.scale * (share @ mine)
            g = softmax(v @ weight + bias)
            g[want] -= 1
            back = weight @ g
            weight -= rate * np.outer(v, g) / (1 + v @ v)
            bias -= rate * 0.1 * g
            embed[ids] = mine - (rate * settings.scale * share)[:, None] * back
    weight = settings.scale * weight
    logits = np.array([(data[k][1] @ embed[data[k][0]]) @ weight + bias for k in (held if len(held) else fit)]) if data else np.zeros((0, len(langs)))
    wants = np.array([data[k][2] for k in (held if len(held) else fit)], int)
    temperature, least = 1.0, 0.0
    if len(wants):
        spread = np.geomspace(0.05, 20, 60)
        loss = [-np.log(softmax(logits / t)[np.arange(len(wants)), wants] + 1e-9).mean() for t in spread]
        temperature = float(spread[int(np.argmin(loss))])
        p = softmax(logits / temperature)
        right, score = p.argmax(axis=1) == wants, p.max(axis=1)
        by_score = np.argsort(-score, kind="stable")
        share = np.cumsum(right[by_score]) / np.arange(1, len(wants) + 1)
        enough = np.flatnonzero(share >= settings.keep_right)
        least = float(score[by_score[enough[-1]]]) if len(enough) else 1.0
    return Model(langs, embed, weight, bias, temperature, least)


def drawn(docs: DataFrame, learn: Column, settings: Settings) -> DataFrame:
    """(lang, text) of at most ``settings.sample`` rows of (doc_id, text, lang), an equal part for each language.

    Rows are drawn by a hash of doc_id and text, so rows without doc_id differ, and equal rows are drawn once. Only rows near the top of
    their language's hashes meet the exact rank."""
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(settings.seed)), 1)
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("place", place)
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("place").alias("size"))
    langs = sizes.count()
    each = max(1, settings.sample // max(langs, 1))
    near = F.lit(2.0**63) * F.least(F.lit(1.0), F.lit(4.0 * each + 100) / F.col("size"))
    # one row a language: as a table to send along where they are counted to be few, so texts are not shuffled by language for it
    sizes = F.broadcast(sizes) if langs <= settings.sample else sizes
    some = rows.join(sizes, "lang").filter(F.col("place") <= near).dropDuplicates(["lang", "place"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    return some.withColumn("rank", rank).filter(F.col("rank") <= each).orderBy("place").limit(settings.sample).select("lang", "text")


def fit(docs: DataFrame, learn: Column, settings: Settings = Settings()) -> Model | None:
    """Train on rows of (doc_id, text, lang) where ``learn`` holds, lang isn't null and the text neither."""
    return train(count_subwords(drawn(docs, learn, settings)).collect(), settings)  # at most settings.sample rows of a few kB


def scored(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the likeliest language, its score, and letters of each text."""
    n, width = len(texts), max(1, LOGITS // len(model.langs))
    best, score, letters = np.zeros(n, int), np.zeros(n), np.zeros(n, np.int64)
    sums, total = np.zeros((n, model.embed.shape[1])), np.zeros(n)
    for parts, who in pieces(texts)[0]:
        found, starts, some = subwords(parts)
        np.add.at(letters, who, some)
        for h, good in found:
            rows = model.embed[h]
            rows[~good] = 0
            np.add.at(sums, who, np.add.reduceat(rows, starts, axis=0, dtype=np.float64))
            np.add.at(total, who, np.add.reduceat(good.astype(np.int64), starts))
    mean = sums / np.maximum(total, 1)[:, None]
    for at in range(0, n, width):  # languages come in once a text, not once a subword
        some = slice(at, at + width)
        p = softmax((mean[some] @ model.weight + model.bias) / model.temperature)
        best[some], score[some] = p.argmax(axis=1), np.where(letters[some] > 0, p.max(axis=1), 0.0)
    return best, score, letters


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            none = np.zeros(batch.num_rows, int)
            best, score, letters = scored(batch.column("text").to_pylist(), model) if model is not None else (none, none.astype(float), none)
            names = [model.langs[b] if has else "und" for b, has in zip(best, letters > 0)]
            rejected = score < (model.least if model else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def digest(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs.select("doc_id", "text", "lang"), ~held_out, settings)
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
