"""The state of a pipeline: a DataFrame, its visible fields, and the order its rows came in."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import HAS, Fields, Value, quoted, resolve, shown

#: Columns of this prefix carry the order of the rows and are no fields of a document; those with a d behind it rank downwards.
HIDDEN = "__natural_"
DOWN = f"{HIDDEN}d"
#: Columns of this prefix carry the variables of a pipeline inside a lookup: all it does is done for each of their tuples.
CARRIED = "__carried_"


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    #: Whether the rows lie in order, and whether a $sort gave that order, so that a result has to show it.
    sorted: bool = False
    ranked: bool = False
    #: The variables that stages see, and the columns that carry them.
    variables: dict[str, str] = field(default_factory=dict)

    @property
    def fields(self) -> Fields:
        own = {name: Value(F.col(c), self.df.schema[c].dataType) for name, c in self.variables.items()}
        return Fields.of(self.df.schema, (HIDDEN, CARRIED), own)

    @property
    def hidden(self) -> list[str]:
        return [n for n in self.df.columns if n.startswith(HIDDEN)]

    @property
    def carried(self) -> list[str]:
        return [n for n in self.df.columns if n.startswith(CARRIED)]

    def natural(self) -> list[Column]:
        """The order of the rows: that of the last $sort, then the collection's order or a group's key."""
        if self.hidden:
            return [F.col(n).desc() if n.startswith(DOWN) else F.col(n) for n in self.hidden]
        key = self.fields.get("_id")
        return [F.col("_id")] if key is not None and not isinstance(key, T.NullType | T.MapType) else []

    def of(self, df: DataFrame, sorted: bool | None = None) -> Frame:
        return replace(self, df=df, sorted=self.sorted if sorted is None else sorted)

    def values(self) -> dict[str, Value]:
        """The fields with their columns."""
        fields = self.fields
        return {name: resolve(fields, name) if "." not in name else Value(F.col(quoted(name)), kind) for name, kind in fields.items()}

    def show(self, values: dict[str, Value], df: DataFrame | None = None, sorted: bool | None = None) -> Frame:
        """Documents of the given fields, with the order and variables they had; fields that are missing in all are left out."""
        own = {n: v for n, v in values.items() if v.kind is not None}
        there = [v.present.alias(HAS + n) for n, v in own.items() if v.present is not None]
        df = self.df if df is None else df
        return self.of(df.select(*[v.column.alias(n) for n, v in own.items()], *there, *self.carried, *self.hidden), sorted)

    def by(self, keys: list[tuple[Column, bool]]) -> Frame:
        """The rows in the order of ``keys`` (a column, and whether it ranks upwards); ties keep the order from before the last $sort.

        The order is carried by columns. Rows move only where a limit or the result needs them to.
        """
        base = [n for n in self.hidden if not n.startswith((DOWN, f"{HIDDEN}u"))]
        kept = [F.col(n) for n in base] or [c.alias(f"{HIDDEN}0") for c in self.natural() if not self.hidden]
        made = [c.alias(f"{HIDDEN}u{i}" if up else f"{DOWN}{i}") for i, (c, up) in enumerate(keys)]
        rest = [F.col(quoted(n)) for n in self.df.columns if not n.startswith(HIDDEN)]
        return replace(self, df=self.df.select(*rest, *made, *kept), sorted=False, ranked=True)

    def documents(self) -> DataFrame:
        """The fields, and what tells which documents have them, in order after a $sort; those that are null in every document are of string type."""
        df = self.df.orderBy(*self.natural()) if self.ranked and not self.sorted and self.hidden and not self.carried else self.df
        columns = []
        for name, kind in self.fields.items():
            c = F.col(quoted(name))
            columns.append(c.cast("string").alias(name) if isinstance(kind, T.NullType) else c)
        return df.select(*columns, *[F.col(quoted(HAS + n)) for n in self.fields if n in self.fields.ragged])

    def visible(self) -> DataFrame:
        """The fields alone; a field that a document lacks is null."""
        df = self.documents()
        return df.select(*[shown(F.col(quoted(f.name)), f.dataType).alias(f.name) for f in df.schema if not f.name.startswith(HAS)])


def scan(df: DataFrame, order: list[str]) -> Frame:
    """A collection's frame; ``order`` names the columns that its documents are stored by. Such with two low lines in front are no fields of theirs."""
    own = [F.col(quoted(c)) for c in df.columns if not (c in order and c.startswith("__"))]
    return Frame(df.select(*own, *[F.col(quoted(c)).alias(f"{HIDDEN}{i}") for i, c in enumerate(order)]))
