"""SQLite files as a Spark data source, a partition per table or range of row ids."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

#: Rows that a partition reads, about.
ROWS = 100_000


def _open(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(path: str) -> list[str]:
    """The tables of a database file; bookkeeping tables are left out."""
    with _open(path) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]


def _kind(declared: str):
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if any(w in d for w in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return StringType()
    if any(w in d for w in ("REAL", "FLOA", "DOUB", "NUMERIC", "DEC")):
        return DoubleType()
    return BinaryType() if "BLOB" in d else StringType()


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("path", file).option("table", name)``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no such table: {self.options['table']}")
        return StructType([StructField(c[1], _kind(c[2])) for c in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], schema)


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType):
        self.path, self.table, self.kinds = path, table, [f.dataType.typeName() for f in schema]

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without row ids
                return [InputPartition(None)]
        if low is None:
            return [InputPartition((0, 0))]
        return [InputPartition((i, min(high, i + ROWS - 1))) for i in range(low, high + 1, ROWS)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        where = "" if partition.value is None else " WHERE rowid BETWEEN ? AND ?"
        make = {"long": int, "double": float, "string": lambda x: x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x), "binary": lambda x: x if isinstance(x, bytes) else str(x).encode()}
        with _open(self.path) as db:
            db.text_factory = bytes
            for row in db.execute(f"SELECT * FROM {_quoted(self.table)}{where}", partition.value or ()):
                yield tuple(None if x is None else make[k](x) for k, x in zip(self.kinds, row, strict=True))


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).load()
