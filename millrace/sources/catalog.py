"""Databases and their collections."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import HAS, quoted


@dataclass(frozen=True)
class Collection:
    """Documents of one schema; ``order`` names the columns that tell in which order they are stored."""

    df: DataFrame
    order: list[str] = field(default_factory=list)


class Catalog:
    """A registry of databases; names are plain strings and never become SQL."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._databases: dict[str, dict[str, Collection]] = {}

    def register(self, database: str, name: str, df: DataFrame, order: list[str] | None = None) -> None:
        self._databases.setdefault(database, {})[name] = Collection(df, list(order or []))

    def collection(self, database: str, name: str) -> Collection | None:
        return self._databases.get(database, {}).get(name)

    def databases(self) -> list[str]:
        return sorted(self._databases)

    def collections(self, database: str) -> dict[str, Collection]:
        return dict(self._databases.get(database, {}))

    def counts(self, database: str) -> DataFrame:
        """collection and n, the number of its documents."""
        parts = [c.df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("collection"), "n") for name, c in sorted(self.collections(database).items())]
        out = parts[0] if parts else self.spark.createDataFrame([], "collection string, n long")
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def verify(self, expected: dict[str, list[str]]) -> dict[str, list[str]]:
        """Of each database the expected collections that are absent or empty; databases without any are left out."""
        out: dict[str, list[str]] = {}
        for database, names in expected.items():
            have = self.collections(database)
            if lacking := [n for n in names if n not in have or have[n].df.isEmpty()]:
                out[database] = lacking
        return out

    def cards(self) -> DataFrame:
        """A schema card for each collection: id, database, collection, fields, doc_count and text.

        The fields are those of the collection's first document. A field's type
        is that of its values; those that some documents lack or have as null are
        marked nullable, those of nulls alone unknown. One aggregate runs per
        collection.
        """
        rows = []
        for database in self.databases():
            for name, c in self.collections(database).items():
                rows.append(_card(database, name, c))
        schema = "id string, database string, collection string, fields array<struct<name: string, type: string>>, doc_count long, text string"
        return self.spark.createDataFrame(rows, schema)


#: What a column type is called on a schema card.
NAMES = {"string": "str", "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "boolean": "bool", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "date"}


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return "list"
    return "dict" if isinstance(kind, T.StructType) else NAMES.get(kind.simpleString(), kind.simpleString())


def _card(database: str, name: str, c: Collection) -> tuple:
    df, lacked = c.df, {n.removeprefix(HAS) for n in c.df.columns if n.startswith(HAS)}
    fields = [f for f in df.schema if f.name != "_id" and not f.name.startswith("__")]
    n_full = [F.count(F.col(quoted(f.name))) for f in fields]
    # what the first document has, where documents differ
    first = [F.min_by(F.col(quoted(HAS + f.name)), F.struct(*[F.col(quoted(o)) for o in c.order])) for f in fields if f.name in lacked] if c.order else [F.first(F.col(quoted(HAS + f.name))) for f in fields if f.name in lacked]
    counts = df.agg(F.count(F.lit(1)), *n_full, *first).first()
    n, types = counts[0], []
    there = dict(zip((f.name for f in fields if f.name in lacked), counts[1 + len(fields) :], strict=True))
    for f, full in zip(fields, counts[1:], strict=False):
        if there.get(f.name, True):
            types.append((f.name, ("unknown" if not full else type_name(f.dataType)) + (", nullable" if full < n else "")))
    if not n:
        types = []
    text = f"database: {database}\ncollection: {name}\nfields: " + ", ".join(f"{k} ({v})" for k, v in types)
    return f"{database}.{name}", database, name, types, n, text
