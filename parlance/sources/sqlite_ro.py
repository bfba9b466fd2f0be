"""Spark data source ``sqlite_ro``: tables of SQLite files, read-only, in parallel row-id ranges.

    spark.read.format("sqlite_ro").option("path", "/mnt/stores/*.db").option("table", "message").load()

Options: ``path`` (file or glob, comma separated), ``table``, ``rows_per_partition`` (default 200000).
``table`` may be ``@columns``, which lists (table_name, column_name, declared_type) of every file.
With an explicit schema, columns a file lacks are NULL, ``_file`` is the file a row came from, and
``_corrupt`` names columns whose stored value does not fit the requested type. The files have to be
on storage every executor mounts. As a stream, each file is followed by its highest row id.
"""

from __future__ import annotations

import glob
import json
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from parlance.sources.contracts import storage_class

FORMAT = "sqlite_ro"
COLUMNS_TABLE = "@columns"
FILE_COLUMN, CORRUPT_COLUMN = "_file", "_corrupt"
BATCH_ROWS = 10_000

COLUMNS_SQL = """
    SELECT m.name AS table_name, p.name AS column_name, p.type AS declared_type
    FROM sqlite_master m JOIN pragma_table_info(m.name) p WHERE m.type = 'table'
"""
SPARK_TYPES = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "NUMERIC": T.DoubleType(),
               "TEXT": T.StringType(), "BLOB": T.BinaryType()}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)


@dataclass
class RowRange(InputPartition):
    file: str
    low: int | None = None
    high: int | None = None


def connect(file: str) -> sqlite3.Connection:
    """Read-only, but not immutable: a writer may hold a write-ahead log."""
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


def files_of(options: dict) -> list[str]:
    found: list[str] = []
    for pattern in options["path"].split(","):
        found += sorted(glob.glob(pattern.strip())) or [pattern.strip()]
    return found


def _exists(con: sqlite3.Connection, table: str) -> bool:
    return con.execute("SELECT 1 FROM sqlite_master WHERE type IN ('table', 'view') AND name = ? COLLATE NOCASE", (table,)).fetchone() is not None


def _has_rowid(con: sqlite3.Connection, table: str) -> bool:
    return not any(r[0] for r in con.execute("SELECT wr FROM pragma_table_list WHERE name = ? COLLATE NOCASE AND schema = 'main'", (table,)))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType | str:
        table = self.options["table"]
        if table == COLUMNS_TABLE:
            return "table_name string, column_name string, declared_type string"
        with connect(files_of(self.options)[0]) as con:
            rows = con.execute("SELECT name, type FROM pragma_table_info(?)", (table,)).fetchall()
        return T.StructType([
            T.StructField(name, SPARK_TYPES.get(storage_class(kind), T.StringType())) for name, kind in rows
        ])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return SqliteStreamReader(self.options, schema)


class _TableScan:
    """What the batch and the stream reader share: bounds, ranges and the scan of one range."""

    def __init__(self, options: dict, schema: T.StructType):
        self.options = dict(options)
        self.files = files_of(options)
        self.table = options["table"]
        self.step = int(options.get("rows_per_partition", 200_000))
        self.columns = schema

    def bounds(self, file: str) -> tuple[int, int] | None:
        """Lowest and highest row id, None for an empty or absent table. Other failures, as of a locked file, are raised."""
        with connect(file) as con:
            if not _exists(con, self.table):
                return None
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return None if high is None else (low, high)

    def keyed_only(self, file: str) -> bool:
        """Whether the table exists but has no row ids (WITHOUT ROWID): it is read in one piece."""
        with connect(file) as con:
            return _exists(con, self.table) and not _has_rowid(con, self.table)

    def ranges(self, file: str, low: int, high: int) -> list[RowRange]:
        """Even steps where ids are dense; where they are sparse, the ids of every ``step``-th row."""
        if (high - low) // self.step <= 1000:
            return [RowRange(file, at, min(at + self.step - 1, high)) for at in range(low, high + 1, self.step)]
        with connect(file) as con:
            starts = [r[0] for r in con.execute(
                f'SELECT id FROM (SELECT rowid AS id, row_number() OVER (ORDER BY rowid) AS k FROM "{self.table}" WHERE rowid BETWEEN ? AND ?) '
                f"WHERE (k - 1) % ? = 0", (low, high, self.step))]
        return [RowRange(file, a, b - 1) for a, b in zip(starts, [*starts[1:], high + 1])]

    def scan(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        with connect(part.file) as con:
            cursor = self._cursor(con, part)
            names = [d[0] for d in cursor.description]
            while rows := cursor.fetchmany(BATCH_ROWS):
                yield self._batch(part.file, names, rows)

    def _cursor(self, con: sqlite3.Connection, part: RowRange) -> sqlite3.Cursor:
        if self.table == COLUMNS_TABLE:
            return con.execute(COLUMNS_SQL)
        present = {r[0].lower() for r in con.execute("SELECT name FROM pragma_table_info(?)", (self.table,))}
        wanted = [f.name for f in self.columns if f.name.lower() in present or f.name.lower() == "rowid"]
        listed = ", ".join(f'"{n}" AS "{n}"' for n in wanted) or "1"
        if part.low is None:
            return con.execute(f'SELECT {listed} FROM "{self.table}"')
        return con.execute(f'SELECT {listed} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?',
                           (part.low, part.high))

    def _batch(self, file: str, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
        by_name = dict(zip(names, zip(*rows)))
        notes: list[list[str]] = [[] for _ in rows]
        arrays = []
        for field in self.columns:
            if field.name == FILE_COLUMN:
                values = [file] * len(rows)
            elif field.name == CORRUPT_COLUMN:
                values = [None] * len(rows)
            else:
                values = [
                    fit(v, field.dataType, notes[k], field.name)
                    for k, v in enumerate(by_name.get(field.name, (None,) * len(rows)))
                ]
            arrays.append(pa.array(values, type=arrow_type(field.dataType)))
        if CORRUPT_COLUMN in self.columns.names:
            at = self.columns.names.index(CORRUPT_COLUMN)
            arrays[at] = pa.array([", ".join(n) or None for n in notes], type=pa.string())
        return pa.RecordBatch.from_arrays(arrays, names=self.columns.names)


def arrow_type(kind: T.DataType) -> pa.DataType:
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(),
            T.BinaryType: pa.binary()}.get(type(kind), pa.string())


def fit(value, kind: T.DataType, notes: list[str], name: str):
    """A stored value as the requested type; SQLite lets any value sit in any column."""
    if value is None:
        return None
    if isinstance(kind, (T.LongType, T.IntegerType)) and isinstance(value, int):
        return value
    if isinstance(kind, T.DoubleType) and isinstance(value, (int, float)):
        return float(value)
    if isinstance(kind, T.BinaryType) and isinstance(value, (bytes, str)):
        return value if isinstance(value, bytes) else value.encode()
    if isinstance(kind, T.StringType) and not isinstance(value, bytes):
        return str(value)
    notes.append(f"{name}:{type(value).__name__}")
    return None


class SqliteReader(_TableScan, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        if self.table == COLUMNS_TABLE:
            return [RowRange(f) for f in self.files]
        parts: list[InputPartition] = []
        for file in self.files:
            if self.keyed_only(file):
                parts.append(RowRange(file))
                continue
            span = self.bounds(file)
            parts += self.ranges(file, *span) if span else []
        return parts or [RowRange("")]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        return self.scan(partition) if partition.file else iter(())


class SqliteStreamReader(_TableScan, DataSourceStreamReader):
    """Offsets are the highest row id seen per file; executors read the ranges in between."""

    def initialOffset(self) -> dict:
        return {"rows": json.dumps({})}

    def latestOffset(self) -> dict:
        """Stores that appear while the stream runs are followed from their first row."""
        self.files = files_of(self.options)
        spans = {f: self.bounds(f) for f in self.files}
        return {"rows": json.dumps({f: s[1] for f, s in spans.items() if s}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        seen, latest = json.loads(start["rows"]), json.loads(end["rows"])
        parts: list[InputPartition] = []
        for file, high in latest.items():
            span = self.bounds(file)
            low = seen[file] + 1 if file in seen else (span[0] if span else 0)
            if high >= low:
                parts += self.ranges(file, low, high)
        return parts or [RowRange("")]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        return self.scan(partition) if partition.file else iter(())

    def commit(self, end: dict) -> None:
        return None
