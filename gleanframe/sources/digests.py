"""SHA-256 of every file below a folder, read in chunks: files of any size, none held whole.

A Python data source: the driver lists the files (paths and sizes only) and deals them into
partitions of about ``partition_bytes``; each task opens its files through ``pyarrow.fs`` (local,
mounted shared folders, and the stores pyarrow reaches) and updates the digest chunk by chunk,
so memory stays at one chunk whatever the file's size. ``binaryFile`` would hold a whole file in
one value (and cannot pass 2 GB).
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length bigint, sha256 string"
CHUNK_BYTES = 1 << 20
PARTITION_BYTES = 256 << 20


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["root"].rstrip("/")
        self.glob = options.get("glob", "*")
        self.chunk = int(options.get("chunk_bytes", CHUNK_BYTES))
        self.part = int(options.get("partition_bytes", PARTITION_BYTES))

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        system, base = self._fs()
        found = [
            (info.path, info.size)
            for info in system.get_file_info(fs.FileSelector(base, recursive=True))
            if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.glob)
        ]
        found.sort()
        parts, current, size = [], [], 0
        for path, length in found:
            if current and size + length > self.part:
                parts.append(_Files(current))
                current, size = [], 0
            current.append((path, length))
            size += length
        if current:
            parts.append(_Files(current))
        return parts or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, base = self._fs()
        for path, _ in partition.files:
            digest, length = hashlib.sha256(), 0
            with system.open_input_stream(path) as stream:
                while chunk := stream.read(self.chunk):
                    digest.update(chunk)
                    length += len(chunk)
            yield path[len(base.rstrip("/")) + 1 :], length, digest.hexdigest()


class FileDigestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gleanframe_file_digests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def file_digests(spark: SparkSession, root: str, glob: str = "*", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``path`` (below ``root``), ``length`` and ``sha256`` of every file below ``root`` whose name matches ``glob``."""
    spark.dataSource.register(FileDigestSource)
    return (
        spark.read.format(FileDigestSource.name())
        .option("root", root)
        .option("glob", glob)
        .option("chunk_bytes", str(chunk_bytes))
        .load()
    )
