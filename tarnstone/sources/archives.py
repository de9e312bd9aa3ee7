"""ZIP archives as a data source: a large archive is read by many tasks, entry by entry.

Partitions come from the archives' central directories, which stand at their ends: entries of about PART bytes together make a partition, and a
task reads the ranges of its own entries, never a whole archive. Paths are opened through Arrow's file systems (local, HDFS, object stores).
Refusals are rows, as :func:`tarnstone.sources.files.unzip` has them.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import MAX_BATCH_ENTRIES, MAX_UPLOAD_BYTES

#: Bytes of the entries of a partition, about, as they are stored.
PART = 32_000_000
SCHEMA = "archive string, nth int, path string, content binary, byte_size bigint, reason string"
BROKEN = (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, ValueError, OSError)


def opened(path: str):
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(at)


def archives(path: str) -> list[str]:
    """The files of a folder that begin like an archive, or the one file."""
    whole = "://" in path or path.startswith("file:")
    fs, at = pafs.FileSystem.from_uri(path) if whole else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(at)
    found = [info.path] if info.type == pafs.FileType.File else sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.File)
    out = []
    for name in found:
        with fs.open_input_file(name) as f:
            if f.read(2) == b"PK":
                out.append(f"{path.partition('://')[0]}://{name}" if whole else name)
    return out


class Entries(InputPartition):
    """Numbers of some entries of an archive, or one refusal of it."""

    def __init__(self, archive: str, numbers: list[int], refusal: str | None = None):
        self.archive, self.numbers, self.refusal = archive, numbers, refusal


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.entries = int(options.get("mostEntries", MAX_BATCH_ENTRIES))
        self.bytes = int(options.get("mostBytes", MAX_UPLOAD_BYTES))
        self.part = int(options.get("partBytes", PART))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for archive in archives(self.path):
            try:
                with opened(archive) as f, zipfile.ZipFile(f) as z:
                    infos = [(n, i) for n, i in enumerate(z.infolist()) if not i.is_dir()]
            except BROKEN:
                out.append(Entries(archive, [], "corrupt"))
                continue
            if len(infos) > self.entries:
                out.append(Entries(archive, [], "too_many_entries"))
                continue
            held, size = [], 0
            for n, info in infos:
                if held and size + info.compress_size > self.part:
                    out.append(Entries(archive, held))
                    held, size = [], 0
                held.append(n)
                size += info.compress_size
            if held:
                out.append(Entries(archive, held))
        return out or [Entries("", [])]

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        if partition.refusal:
            yield self._row(partition.archive, -1, None, None, None, partition.refusal)
        if not partition.numbers:
            return
        with opened(partition.archive) as f, zipfile.ZipFile(f) as z:
            infos = z.infolist()
            for n in partition.numbers:
                info = infos[n]
                if info.file_size > self.bytes:
                    yield self._row(partition.archive, n, info.filename, None, info.file_size, "too_large")
                    continue
                try:
                    body = z.read(info)
                except BROKEN:
                    yield self._row(partition.archive, n, info.filename, None, info.file_size, "corrupt")
                    continue
                nested = body[:4] == b"PK\x03\x04"
                yield self._row(partition.archive, n, info.filename, None if nested else body, len(body), "nested_zip" if nested else None)

    def _row(self, *values) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options)


def read_archives(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """archive, nth, path, content, byte_size and reason of every entry of the archives at ``path``.

    Options: mostEntries, mostBytes, partBytes.
    """
    spark.dataSource.register(ZipSource)
    reader = spark.read.format("archive")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)
