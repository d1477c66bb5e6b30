"""Session defaults for local runs and tests; on a cluster the given session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "6g", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))  # Python workers need the package too
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(filter(None, [root, *os.environ.get("PYTHONPATH", "").split(os.pathsep)])))
    return builder.getOrCreate()
