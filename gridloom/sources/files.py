"""Files by extension or format."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.sources import arrow_ipc, json_parts

#: Extension -> (format, options).
READERS: dict[str, tuple[str, dict[str, str]]] = {
    "csv": ("csv", {"header": "true", "inferSchema": "true"}),
    "txt": ("csv", {"header": "true", "inferSchema": "true"}),
    "tsv": ("csv", {"header": "true", "inferSchema": "true", "sep": "\t"}),
    "parquet": ("parquet", {}),
    "json": ("json", {"multiLine": "true"}),
    "jsonl": ("json", {}),
    "ndjson": ("json", {}),
    "feather": (arrow_ipc.NAME, {}),
    "ipc": (arrow_ipc.NAME, {}),
    "arrow": (arrow_ipc.NAME, {}),
}
FORMATS = ("csv", "parquet", "json")


def extension(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def exists(spark: SparkSession, path: str) -> bool:
    """By Spark's own file systems, so that remote paths count too."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(target)
    return found is not None and len(found) > 0


def load(spark: SparkSession, path: str, format: str | None = None, schema=None, columns: list[str] | None = None) -> DataFrame:
    """Read by the path's extension (unknown ones as CSV), or by ``format``: csv, parquet or json. A given schema saves CSV a scan. Of Arrow
    files only ``columns`` are decoded; the other formats' scans see by themselves which columns a query needs."""
    if format is not None and format not in FORMATS:
        raise ValueError(f"Unsupported file format: {format}")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    kind, options = READERS.get(format or extension(path), READERS["csv"])
    if kind == arrow_ipc.NAME:
        arrow_ipc.register(spark)
        if columns is not None and schema is None:
            full = spark.read.format(kind).load(path).schema
            schema = StructType([full[c] for c in columns])
    if kind == "json" and options and (lines := json_parts.is_lines(spark, path)) is not None:
        if not lines:
            whole = json_parts.read(spark, path, schema)
            return whole if columns is None else whole.select(*[F.col(f"`{c}`") for c in columns])
        options = {}
    reader = spark.read.format(kind).options(**options)
    if schema is not None:
        reader = spark.read.format(kind).options(**{k: v for k, v in options.items() if k != "inferSchema"}).schema(schema)
    whole = reader.load(path)
    return whole if columns is None else whole.select(*[F.col(f"`{c}`") for c in columns])


def load_as_table(spark: SparkSession, path: str, table: str, format: str | None = None) -> DataFrame:
    df = load(spark, path, format)
    df.createOrReplaceTempView(table)
    return df


def check(spark: SparkSession, path: str) -> str | None:
    """Why a source can't be loaded, or None: it must exist, have a known extension and a readable first row."""
    if not exists(spark, path):
        return "File does not exist"
    if extension(path) not in READERS:
        return f"Unsupported file type: {extension(path) or 'none'}"
    try:
        df = load(spark, path)
        if not df.columns or not df.limit(5).collect():
            return "File is empty"
    except Exception as error:  # any reader's complaint is the answer
        return f"File cannot be read: {str(error).splitlines()[0]}"
    return None


def bad_lines(spark: SparkSession, path: str, schema: str) -> int:
    """Lines of a CSV with header that don't fit a schema."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    header = lines.first()
    if header is None:
        return 0
    read = F.from_csv("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.filter(F.col("value") != header.value).select(read.alias("r")).filter("r._corrupt_record is not null").count()


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def empty_table(spark: SparkSession, rows: int = 10, columns: int = 5) -> DataFrame:
    return spark.range(rows).select(*[F.lit(None).cast("string").alias(f"Column_{k + 1}") for k in range(columns)])


def save(df: DataFrame, path: str, format: str | None = None, mode: str = "overwrite") -> str:
    """Write by extension (unknown ones become .csv) or format; returns the path. The output is a folder of part files, all rows of the
    lazy frame, whatever page of it was shown."""
    if format is not None and format not in FORMATS:
        raise ValueError(f"Unsupported file format: {format}")
    if not df.columns:
        raise ValueError("No data to save")
    if format is None and extension(path) not in READERS:
        path += ".csv"
    kind = format or extension(path)
    if kind in ("csv", "txt", "tsv"):
        df.write.mode(mode).option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind == "parquet":
        df.write.mode(mode).parquet(path)
    elif kind in ("json", "jsonl", "ndjson"):
        df.write.mode(mode).json(path)
    else:
        arrow_ipc.register(df.sparkSession)
        df.write.format(arrow_ipc.NAME).mode("append" if mode == "append" else "overwrite").save(path)
    return path


def _moved(system, source, target) -> bool:
    """Rename by a Hadoop file system; some say no, others raise."""
    try:
        return system.rename(source, target)
    except Py4JJavaError:
        return False


def save_over_source(df: DataFrame, path: str, format: str | None = None) -> str:
    """Replace the files that ``df`` may itself be read from: written beside them first, then swapped by renaming."""
    spark = df.sparkSession
    if not exists(spark, path):
        raise FileNotFoundError(path)
    staging = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    kind = format or extension(path)
    if kind in ("feather", "ipc", "arrow"):
        arrow_ipc.register(spark)
        df.write.format(arrow_ipc.NAME).mode("overwrite").save(staging)
    elif kind == "parquet":
        df.write.parquet(staging)
    elif kind in ("json", "jsonl", "ndjson"):
        df.write.json(staging)
    else:
        df.write.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(staging)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    system = path_of(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    old = path_of(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    if not _moved(system, path_of(path), old):
        raise OSError(f"{path} could not be moved aside; the new rows are in {staging}")
    if not _moved(system, path_of(staging), path_of(path)):
        back = _moved(system, old, path_of(path))
        raise OSError(f"{staging} could not take the place of {path}; the old rows are in {path if back else old.toString()}")
    system.delete(old, True)
    return path
