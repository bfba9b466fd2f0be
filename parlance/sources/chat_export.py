"""Spark data source ``chat_export``: lines of ``<folder>/_chat.txt`` files, split into byte ranges.

    spark.read.format("chat_export").option("path", "/mnt/exports").load()

Spark's own file sources skip names that start with an underscore. One row per line: ``folder``,
``pos`` (byte offset of the line, which orders the lines of a folder) and ``line``. A large file is
read by several tasks: each range starts after the first line break it meets and ends with the line
that crosses its end; small files share a task. Options: ``path`` (root folder or URI), ``split_bytes`` (default 64 MiB).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "chat_export"
FILE_NAME = "_chat.txt"
SCHEMA = "folder string, pos bigint, line string"
SPLIT_BYTES = 64 * 1024 * 1024
BATCH_LINES = 10_000
CHUNK = 1024 * 1024


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChatExportSource)


@dataclass
class ByteRange:
    path: str
    folder: str
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Byte ranges one task reads: part of a large file, or many small files."""

    ranges: list[ByteRange]


def open_root(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        fs.LocalFileSystem(), path)


class ChatExportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChatExportReader(self.options)


class ChatExportReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        system, base = open_root(self.root)
        listed = system.get_file_info(fs.FileSelector(base, recursive=True))
        ranges: list[ByteRange] = []
        for info in listed:
            if info.type == fs.FileType.File and info.base_name == FILE_NAME:
                folder = info.path[len(base):-len(FILE_NAME)].strip("/")
                ranges += [ByteRange(info.path, folder, at, min(at + self.split, info.size))
                           for at in range(0, info.size, self.split)]
        return self.packed(ranges) or [Ranges([])]

    def packed(self, ranges: list[ByteRange]) -> list[InputPartition]:
        """Ranges put together until a task has about ``split_bytes`` to read."""
        parts: list[InputPartition] = []
        current: list[ByteRange] = []
        size = 0
        for r in ranges:
            if current and size + r.end - r.start > self.split:
                parts.append(Ranges(current))
                current, size = [], 0
            current.append(r)
            size += r.end - r.start
        return parts + ([Ranges(current)] if current else [])

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = open_root(self.root)
        for part in partition.ranges:
            with system.open_input_file(part.path) as stream:
                lines = range_lines(stream, part.start, part.end)
                while rows := list(islice(lines, BATCH_LINES)):
                    yield to_batch(part.folder, rows)


def to_batch(folder: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([folder] * len(rows)), pa.array([r[0] for r in rows], type=pa.int64()),
         pa.array([r[1] for r in rows], type=pa.string())],
        names=["folder", "pos", "line"])


def range_lines(stream, start: int, end: int) -> Iterator[tuple[int, str]]:
    """Lines that begin inside [start, end); the line open at ``start`` belongs to the range before."""
    at, skipping, rest, more = start, bool(start), b"", b"?"
    if start:
        at = start - 1
        stream.seek(at)
    while more and (skipping or at < end):
        more = stream.read(CHUNK)
        *lines, rest = (rest + more).split(b"\n")
        if not more and rest:
            lines = [rest]
        for raw in lines:
            if not skipping and at < end:
                yield from pieces(at, raw)
            skipping = False
            at += len(raw) + 1


def pieces(at: int, raw: bytes) -> Iterator[tuple[int, str]]:
    """One line, or several where lone carriage returns end lines."""
    for piece in (raw[:-1] if raw.endswith(b"\r") else raw).split(b"\r"):
        yield at, piece.decode("utf-8", errors="replace")
        at += len(piece) + 1
