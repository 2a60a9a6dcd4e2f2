"""Heads of files as a Spark data source: files are planned on the driver, their first bytes are read in tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read of each file, and files that one task reads.
HEAD_BYTES, FILES_AT_A_TIME = 65_536, 500


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path on it."""
    path = re.sub(r"^file:/+", "/", re.sub(r"^s3[an]:", "s3:", path))
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class SomeFiles(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class HeadReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        system, root = located(self.path)
        own = system.get_file_info(root)
        if own.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [own] if own.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        # Names that begin like this are hidden, as for Spark's own sources.
        seen = lambda name: not any(part[:1] in ("_", ".") for part in name[len(root) :].split("/"))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and (f is own or seen(f.path)))
        return [SomeFiles(files[k : k + FILES_AT_A_TIME]) for k in range(0, len(files), FILES_AT_A_TIME)] or [SomeFiles([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.path)
        for path, length in partition.files:
            with system.open_input_stream(path, compression=None) as stream:
                head = stream.read(self.size)
            yield pa.RecordBatch.from_pydict({"path": [path], "length": [length], "head": [head]}, schema=pa.schema([("path", pa.string()), ("length", pa.int64()), ("head", pa.binary())]))


class FileHeads(DataSource):
    """(path, length, head) of every file below ``path``; ``size`` is the number of bytes read of each."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, length long, head binary"

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options["path"], int(self.options.get("size", HEAD_BYTES)))


def file_heads(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> DataFrame:
    """(path, length, head) per file of a file or folder: at most ``size`` bytes of each are read, and by one task."""
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("size", str(size)).load(path)
