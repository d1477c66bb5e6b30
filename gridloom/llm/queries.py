"""The thirteen operators as registered queries, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import ann, chat, decontam, fingerprint, langid, mixing, ngram_join, packing, quality, repair, secrets, trie, urlrules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.digest(_table(spark, sf_dir, "embeddings"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.selectExpr("doc_id", "source", "__epoch as epoch", "__block as block", "__position as position", "__tokens as tokens", "__weight as weight", "__place as place")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(_table(spark, sf_dir, "conversations"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(_table(spark, sf_dir, "pages"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(_table(spark, sf_dir, "conversations"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.digest(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_nearest, op2_fingerprints, op3_mixing, op4_chat, op5_language, op6_secrets, op7_packing, op8_quality, op9_ngram_join, op10_url_rules, op11_repair, op12_decontamination, op13_trie)}
ORACLES: dict[str, str] = {}
