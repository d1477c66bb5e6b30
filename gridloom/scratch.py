"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints; where none is set, a temporary one on a local master, and an error on a cluster, whose machines
    would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "folder" not in _LOCAL:
        made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, made, True)
        _LOCAL["folder"] = f"file://{made}"
    return _LOCAL["folder"]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; ``clean`` deletes what is written there."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Delete all tables that this driver has settled; returns how many. To be called when no frame that reads them is needed any more."""
    conf, gone = spark._jsparkSession.sessionState().newHadoopConf(), 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone
