"""From raw documents to packed training sequences: each stage works on all that its predecessor kept.

Stages but the last return the columns of ``documents``; the last returns pieces of packed sequences. The stages can't be expressed in
SQL as a whole (a trained classifier, MinHash, a tokenizer), so ORACLE_SQL is None and tests hold the stages against plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import mixing, ngram_join, packing, quality, secrets
from gridloom.llm.shared import settle


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _safe(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with neutral names for columns that operators don't know, and what gives the names back."""
    names = {c: c if c in OWN else f"extra_{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return renamed, lambda out: out.select(*[F.col(n).alias(c) for c, n in names.items()])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is under 0.3. Without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    model = quality.fit_texts(docs, quality.drawn(labels, ~quality.held_out()))
    return docs.filter(quality.score_text(F.col("text"), model) >= 0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document with the least doc_id stays; rows without doc_id all stay."""
    docs, named = _safe(docs)
    kept = ngram_join.firsts(docs).select(F.col("doc_id").alias("__kept"), F.col("digest").alias("__of"))
    rows = docs.filter("doc_id is not null").withColumn("__text", ngram_join.digest_of(F.col("text")))
    rows = rows.join(kept, (rows["doc_id"] == kept["__kept"]) & (rows["__text"] == kept["__of"]), "left_semi")
    # where a row is repeated, its first stays
    first = Window.partitionBy("doc_id", "__text").orderBy(F.col("text").asc_nulls_last(), "source", "lang")
    known = rows.withColumn("__place", F.row_number().over(first)).filter("__place = 1").drop("__place", "__text")
    return named(known.unionByName(docs.filter("doc_id is null")))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes ``[SECRET]``; the documents stay."""
    docs, named = _safe(docs)
    return named(secrets.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources raised towards equal weights, none repeated more than twice; every document is taken at least once."""
    docs, named = _safe(docs)
    return named(mixing.mix(docs, mixing.Target(repeats=2.0)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, neighbours on the Hilbert curve together."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
