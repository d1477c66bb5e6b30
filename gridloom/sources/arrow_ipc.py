"""Arrow IPC files as a Python data source (S08, K07): tasks take stretches of record batches, only asked-for columns are decoded.

A file's footer addresses its batches, so a large file is read by several tasks and small files share one; streams have no footer and are one
task each. A folder that this source has written holds a manifest of its files: a write puts its files where no reader looks and then
replaces the manifest, so all become visible at once. Files of the generation before stay until the next overwrite, for readers that have
begun on them. One writer at a time. Files are opened through Arrow's file systems, so a path that the executors can reach is needed.
"""

from __future__ import annotations

import json
import os
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema

NAME = "arrow_ipc"
MANIFEST = "_manifest.json"
#: Bytes of files that a task reads; option ``splitBytes``.
SPLIT = 64 << 20
#: Footers that the driver opens at a time.
AT_ONCE = 16


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _manifest(system, inner: str) -> dict[str, list[str]] | None:
    """{files, former}: names in the folder of the files to read, and of those of the generation before."""
    from pyarrow import fs

    if system.get_file_info(f"{inner}/{MANIFEST}").type != fs.FileType.File:
        return None
    with system.open_input_stream(f"{inner}/{MANIFEST}") as source:
        return json.loads(source.read())


def _listed(system, inner: str) -> list[str]:
    """Names in a folder without manifest, but for hidden files and what lies in hidden folders."""
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    names = [f.path[len(inner.rstrip("/")) + 1 :] for f in found if f.type == fs.FileType.File]
    return sorted(n for n in names if not any(part.startswith(("_", ".")) for part in n.split("/")))


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, inner = _open(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        return [inner]
    held = _manifest(system, inner)
    return [f"{inner}/{n}" for n in (held["files"] if held else _listed(system, inner))]


def _reader(path: str, inner: str, names: list[str] | None = None):
    """A reader of the file, or of the stream, that decodes the columns ``names``; and its source."""
    system, _ = _open(path)
    source = system.open_input_file(inner)
    for opener in (pa.ipc.open_file, pa.ipc.open_stream):  # a stream has no footer
        try:
            source.seek(0)
            reader = opener(source)
            break
        except pa.ArrowInvalid:
            if opener is pa.ipc.open_stream:
                raise
    if names is None:
        return reader, source
    at = [reader.schema.get_field_index(n) for n in names]
    if -1 in at:
        raise ValueError(f"{inner} has no column {names[at.index(-1)]}")
    source.seek(0)
    return opener(source, options=pa.ipc.IpcReadOptions(included_fields=at)), source


class _Part(InputPartition):
    """(file, first batch, batch behind the last) pieces; the last is None for a file as a whole."""

    def __init__(self, pieces: list[tuple[str, int, int | None]]):
        self.pieces = pieces


class _Read(DataSourceReader):
    def __init__(self, path: str, names: list[str], split: int):
        self.path, self.names, self.split = path, names, split

    def partitions(self):
        system, _ = _open(self.path)
        files = _files(self.path)
        sizes = dict(zip(files, (f.size or 0 for f in system.get_file_info(files)))) if files else {}
        large = [f for f in files if sizes[f] > self.split]

        def batches(inner: str) -> int | None:
            reader, source = _reader(self.path, inner)
            with source:
                return getattr(reader, "num_record_batches", None)

        with ThreadPoolExecutor(AT_ONCE) as pool:
            counts = dict(zip(large, pool.map(batches, large)))
        parts, held, weight = [], [], 0
        for f in files:
            if f in counts:
                if counts[f] is None:
                    parts.append(_Part([(f, 0, None)]))
                else:
                    step = max(1, counts[f] * self.split // sizes[f])
                    parts += [_Part([(f, k, min(k + step, counts[f]))]) for k in range(0, counts[f], step)]
                continue
            if held and weight + sizes[f] > self.split:
                parts.append(_Part(held))
                held, weight = [], 0
            held.append((f, 0, None))
            weight += sizes[f]
        return parts + [_Part(held)] if held or not parts else parts

    def read(self, partition):
        for inner, first, last in partition.pieces:
            reader, source = _reader(self.path, inner, self.names)
            with source:
                if hasattr(reader, "num_record_batches"):
                    for k in range(first, reader.num_record_batches if last is None else last):
                        yield reader.get_batch(k).select(self.names)
                else:
                    for batch in reader:
                        yield batch.select(self.names)


class _Done(WriterCommitMessage):
    def __init__(self, part: str | None):
        self.part = part


class _Write(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        self.folder = f"_data-{self.job}"

    def write(self, iterator):
        system, inner = _open(self.path)
        system.create_dir(f"{inner}/{self.folder}", recursive=True)
        part, writer = f"{self.folder}/part-{uuid.uuid4().hex}.arrow", None
        for batch in iterator:
            if writer is None:
                sink = system.open_output_stream(f"{inner}/{part}")
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
        if writer is None:
            return _Done(None)
        writer.close()
        sink.close()
        return _Done(part)

    def commit(self, messages):
        """Parts of the tasks that Spark counts are entered in the manifest, which is replaced by one move; then the files that were replaced
        before the last time go."""
        system, inner = _open(self.path)
        held = _manifest(system, inner) or {"files": _listed(system, inner), "former": []}
        made = [m.part for m in messages if m is not None and m.part]
        new = {"files": made, "former": held["files"]} if self.overwrite else {"files": held["files"] + made, "former": held["former"]}
        draft = f"{inner}/_manifest-{self.job}"
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(draft) as sink:
            sink.write(json.dumps(new).encode())
        system.move(draft, f"{inner}/{MANIFEST}")
        if self.overwrite:
            self._drop(system, inner, held["former"])

    def _drop(self, system, inner: str, names: list[str]) -> None:
        from pyarrow import fs

        for name in names:
            system.delete_file(f"{inner}/{name}")
        for folder in {os.path.dirname(n) for n in names} - {""}:
            if not system.get_file_info(fs.FileSelector(f"{inner}/{folder}", recursive=True)):
                system.delete_dir(f"{inner}/{folder}")

    def abort(self, messages):
        from pyarrow import fs

        system, inner = _open(self.path)
        if system.get_file_info(f"{inner}/{self.folder}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/{self.folder}")


class ArrowIpc(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(self.options["path"])
        reader, source = _reader(self.options["path"], files[0])
        with source:
            return from_arrow_schema(reader.schema)

    def reader(self, schema):
        return _Read(self.options["path"], schema.names, int(self.options.get("splitBytes", SPLIT)))

    def writer(self, schema, overwrite):
        return _Write(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowIpc)
