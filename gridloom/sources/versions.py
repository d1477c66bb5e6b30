"""Tables of Parquet files with versions (Q22, Q23, E09, E10): update, delete and patches rewrite only the files that they hit.

A table is a folder with data files and ``manifest/<version>``, a small Parquet table that names the live files and the schema. A change
finds the files with rows that it concerns (`_metadata.file_path`; Parquet's own ranges skip the others), writes their new rows beside
them, and then puts a manifest in place by one rename, which fails if another writer was first. So readers see one version or the other,
a failed change leaves the table as it was, and earlier versions can be read until ``vacuum`` deletes what they alone hold.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.scratch import settle


class VersionConflict(RuntimeError):
    """Another writer has made the version that this one wanted to make."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    @classmethod
    def create(cls, df: DataFrame, path: str) -> VersionedTable:
        table = cls(df.sparkSession, path)
        table._commit(0, table._write(df), df.schema)
        return table

    def versions(self) -> list[int]:
        folder = self._jpath(f"{self.path}/manifest")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, version: int | None) -> tuple[int, list[str], T.StructType]:
        known = self.versions()
        version = (known or [None])[-1] if version is None else version
        if version not in known:
            raise ValueError(f"No version {version} of {self.path}")
        row = self.spark.read.parquet(f"{self.path}/manifest/{version}").agg(F.collect_list("file").alias("files"), F.max("schema").alias("schema")).first()  # a name for each file
        return version, sorted(row["files"]), T.StructType.fromJson(json.loads(row["schema"]))

    def _commit(self, version: int, files: list[str], kind: T.StructType) -> int:
        rows = [(f, kind.json()) for f in files] or [(None, kind.json())]
        new = f"{self.path}/manifest/.{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, "file string, schema string").coalesce(1).write.parquet(new)
        target = self._jpath(f"{self.path}/manifest/{version}")
        # a rename onto a folder would move into it, so what exists is a conflict
        if self._fs.exists(target) or not self._fs.rename(self._jpath(new), target):
            self._fs.delete(self._jpath(new), True)
            raise VersionConflict(f"Version {version} of {self.path} exists")
        return version

    def _write(self, df: DataFrame) -> list[str]:
        """Write the rows into a folder of their own; its files, relative to the table."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        found = self._fs.listStatus(self._jpath(f"{self.path}/{folder}"))
        return [f"{folder}/{f.getPath().getName()}" for f in found if f.getPath().getName().startswith("part-")]

    def _read(self, files: list[str], kind: T.StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{f}" for f in files])

    def files(self, version: int | None = None) -> list[str]:
        return self._manifest(version)[1]

    def read(self, version: int | None = None) -> DataFrame:
        _, files, kind = self._manifest(version)
        return self._read(files, kind)

    def append(self, df: DataFrame) -> int:
        version, files, kind = self._manifest(None)
        return self._commit(version + 1, files + self._write(df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in kind.fields])), kind)

    def _hit(self, files: list[str], kind: T.StructType, concerned: Callable[[DataFrame], DataFrame]) -> list[str]:
        """The files with a row that is concerned."""
        found = concerned(self._read(files, kind).select("*", F.col("_metadata.file_path").alias("__file"))).select("__file").distinct().collect() if files else []
        names = {r["__file"].rpartition("/")[2] for r in found}
        return [f for f in files if f.rpartition("/")[2] in names]

    def _change(self, concerned: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame]) -> int:
        version, files, kind = self._manifest(None)
        hit = self._hit(files, kind, concerned)
        if not hit:
            return version
        kept = [f for f in files if f not in set(hit)]
        rows = change(self._read(hit, kind)).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in kind.fields])
        return self._commit(version + 1, kept + self._write(rows), kind)

    def delete(self, where: Column) -> int:
        """A new version without the rows for which ``where`` is true."""
        return self._change(lambda df: df.filter(where), lambda df: df.filter(~F.coalesce(where, F.lit(False))))

    def update(self, column: str, value: Column, where: Column) -> int:
        """A new version with ``value`` in the rows for which ``where`` is true."""
        return self._change(lambda df: df.filter(where), lambda df: df.withColumn(column, F.when(where, value).otherwise(F.col(f"`{column}`"))))

    def patch(self, patches: DataFrame, key: str) -> int:
        """Set single cells: ``patches`` has (key, column, value, seq), values as texts, of one cell's patches the one of the highest seq.

        A value that its column can't hold is an error, and no new version is made; so is a patch of a column that there is none of."""
        _, _, kind = self._manifest(None)
        kinds = {f.name: f.dataType for f in kind.fields}
        last = settle(patches.groupBy(key, "column").agg(F.max_by(F.struct("value"), "seq").alias("new")), "patches")
        unknown = [r["column"] for r in last.filter(~F.col("column").isin(*[c for c in kinds if c != key])).select("column").distinct().limit(5).collect()]
        if unknown:
            raise ValueError(f"No such columns to patch: {unknown}")
        wide = last.groupBy(F.col(key).alias("__key")).agg(*[F.first(F.when(F.col("column") == c, F.col("new")), True).alias(f"__new_{k}") for k, c in enumerate(kinds)])
        values = [F.when(F.col(f"__new_{k}").isNotNull(), F.col(f"__new_{k}.value").cast(kinds[c])).otherwise(F.col(f"`{c}`")).alias(c) for k, c in enumerate(kinds)]
        return self._change(
            lambda df: df.join(wide.select("__key"), df[key] == F.col("__key"), "left_semi"),
            lambda df: df.join(wide, df[key] == F.col("__key"), "left").select(*values),
        )

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the last ``keep`` versions and delete the data files that no kept one names; returns how many files went.

        Not to be run beside a writer, whose files no manifest names yet."""
        known = self.versions()
        live = {f for v in known[-keep:] for f in self.files(v)}
        for v in known[:-keep]:
            self._fs.delete(self._jpath(f"{self.path}/manifest/{v}"), True)
        gone = 0
        for folder in self._fs.listStatus(self._jpath(f"{self.path}/data")):
            for f in self._fs.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{f.getPath().getName()}"
                if f.getPath().getName().startswith("part-") and name not in live:
                    gone += bool(self._fs.delete(f.getPath(), False))
        return gone
