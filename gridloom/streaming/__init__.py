"""The stateless expressions on streams: conversion, search and code extraction work row by row, so they need no state or watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gridloom.functions import types
from gridloom.operators import search


def read(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(format).load(path)


def find(stream: DataFrame, column: str, kind: str, value: str | None = None, second: str | None = None) -> DataFrame:
    return search.find(stream, column, kind, value, second)


def convert(stream: DataFrame, column: str, target: str) -> DataFrame:
    return types.convert(stream, column, target)


def write(stream: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """Append to files, exactly once, for what is there now."""
    return stream.writeStream.format(format).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
