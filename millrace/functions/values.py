"""Typed values: every path and expression has a type known before data is read.

Types fall into brackets that never compare as equal and are never coerced into
each other: numbers, strings, booleans, times, documents and arrays. A path that
no document has is missing, which is known as well.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Value:
    """A column and its type; ``kind`` None is missing.

    ``present`` tells of each document whether it has the value, where some have
    not; their column is null. ``full`` says that the column is never null. Of a
    path into an array, ``some`` tells whether one of its elements has the value.
    """

    column: Column
    kind: T.DataType | None
    present: Column | None = None
    full: bool = False
    some: Column | None = None

    @property
    def bracket(self) -> str:
        return bracket(self.kind)


#: Brackets in the order in which values of different types sort.
ORDER = ["missing", "null", "number", "string", "document", "array", "boolean", "time"]


def bracket(kind: T.DataType | None) -> str:
    match kind:
        case None:
            return "missing"
        case T.NullType():
            return "null"
        case T.BooleanType():
            return "boolean"
        case T.NumericType():
            return "number"
        case T.StringType():
            return "string"
        case T.DateType() | T.TimestampType() | T.TimestampNTZType():
            return "time"
        case T.ArrayType():
            return "array"
        case T.StructType() | T.MapType():
            return "document"
    return "other"


#: Columns, and fields of documents, of this prefix tell whether the document has the field named behind it. There is one only where some have not.
HAS = "__has_"


class Fields(dict[str, T.DataType]):
    """Names and types of the fields of documents: those that some documents lack, those that are never null, and the variables beside them."""

    def __init__(self, types: dict[str, T.DataType], ragged: frozenset[str] = frozenset(), full: frozenset[str] = frozenset(), variables: dict[str, Value] | None = None):
        super().__init__(types)
        self.ragged, self.full, self.variables = ragged, full, variables or {}

    @classmethod
    def of(cls, schema: T.StructType, skip: tuple[str, ...] = (), variables: dict[str, Value] | None = None) -> Fields:
        """The fields of rows, without columns whose names begin as in ``skip``."""
        own = [f for f in schema if not f.name.startswith((HAS, *skip))]
        names = set(schema.names)
        return cls({f.name: f.dataType for f in own}, frozenset(f.name for f in own if HAS + f.name in names), frozenset(f.name for f in own if not f.nullable), variables)


def missing() -> Value:
    return Value(F.lit(None), None)


def literal(x: Any) -> Value:
    """A plain value of a query text."""
    match x:
        case None:
            return Value(F.lit(None), T.NullType())
        case bool():
            return Value(F.lit(x), T.BooleanType())
        case int():
            return Value(F.lit(x).cast("long"), T.LongType())
        case float():
            return Value(F.lit(x), T.DoubleType())
        case str():
            return Value(F.lit(x), T.StringType())
        case list():
            items = [literal(i) for i in x]
            kind = items[0].kind if items else T.NullType()
            return Value(F.array(*[i.column for i in items]) if items else F.array(), T.ArrayType(kind))
        case dict():
            fields = {k: literal(v) for k, v in x.items()}
            return document(fields)
    raise TypeError(f"no value: {x!r}")


def document(fields: dict[str, Value]) -> Value:
    """A document of the fields that are not missing."""
    own = {k: v for k, v in fields.items() if v.kind is not None}
    if not own:
        return Value(F.struct(F.lit(None).alias("_")), T.StructType([T.StructField("_", T.NullType())]))
    parts = [(k, v.column, v.kind) for k, v in own.items()] + [(HAS + k, v.present, T.BooleanType()) for k, v in own.items() if v.present is not None]
    return Value(F.struct(*[c.alias(k) for k, c, _ in parts]), T.StructType([T.StructField(k, kind) for k, _, kind in parts]), full=True)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def resolve(root: dict[str, T.DataType], path: str, base: Value | None = None) -> Value:
    """The value at a dotted path of columns, or of ``base``; over arrays, of each element."""
    first, *rest = path.split(".")
    if base is None:
        if first not in root:
            return missing()
        there = F.col(quoted(HAS + first)) if first in getattr(root, "ragged", ()) else None
        at = Value(F.col(quoted(first)), root[first], there, first in getattr(root, "full", ()))
    else:
        at, rest = base, [first, *rest]
    for name in rest:
        at = _field(at, name)
    return at


def _field(at: Value, name: str) -> Value:
    match at.kind:
        case T.StructType() as s if name in s.names:
            there = F.coalesce(at.column.getField(HAS + name), F.lit(False)) if HAS + name in s.names else None if at.full else at.column.isNotNull()
            return Value(at.column.getField(name), s[name].dataType, there, at.full and not s[name].nullable)
        case T.ArrayType(elementType=T.StructType() as s) if name in s.names:
            inner = s[name].dataType
            found = F.transform(at.column, lambda x: x.getField(name))
            there = None if at.full else at.column.isNotNull()
            some = F.coalesce(F.exists(at.column, lambda x: F.coalesce(x.getField(HAS + name), F.lit(False)) if HAS + name in s.names else x.isNotNull()), F.lit(False))
            if isinstance(inner, T.ArrayType):  # one level of arrays for each step
                return Value(F.flatten(F.filter(found, lambda x: x.isNotNull())), inner, there, some=some)
            return Value(found, T.ArrayType(inner), there, some=some)
    return missing()


def shown(column: Column, kind: T.DataType) -> Column:
    """A value without the fields that tell of other fields; absent fields are null."""
    if not _marked(kind):
        return column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: shown(x, kind.elementType))
    parts = [shown(column.getField(f.name), f.dataType).alias(f.name) for f in kind if not f.name.startswith(HAS)]
    return F.when(column.isNotNull(), F.struct(*parts))


def _marked(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _marked(kind.elementType)
    return isinstance(kind, T.StructType) and any(f.name.startswith(HAS) or _marked(f.dataType) for f in kind)


def without_absent(x: Any) -> Any:
    """A collected document, or list of them, without the fields that it lacks."""
    match x:
        case dict():
            return {k: without_absent(v) for k, v in x.items() if not k.startswith(HAS) and x.get(HAS + k, True)}
        case list():
            return [without_absent(v) for v in x]
    return x


def common_number(a: T.DataType, b: T.DataType) -> T.DataType:
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return T.LongType() if isinstance(a, whole) and isinstance(b, whole) else T.DoubleType()


def same(a: Value, b: Value) -> Column:
    """Equality as expressions see it: null equals null and missing, other types never meet."""
    x, y = a.bracket, b.bracket
    if {x, y} <= {"missing", "null"}:
        return F.lit(True)
    if x in ("missing", "null"):
        return b.column.isNull()
    if y in ("missing", "null"):
        return a.column.isNull()
    if x != y:
        return a.column.isNull() & b.column.isNull()
    return a.column.eqNullSafe(b.column)


def less(a: Value, b: Value) -> Column:
    """Whether a sorts before b: nulls first, then by bracket, then by value."""
    x, y = a.bracket, b.bracket
    empty = ("missing", "null")
    if y in empty:
        return F.lit(False)
    if x in empty:
        return b.column.isNotNull()
    if x != y:
        below = F.lit(ORDER.index(x) < ORDER.index(y)) if x in ORDER and y in ORDER else F.lit(False)
        return b.column.isNotNull() & (a.column.isNull() | below)
    return F.coalesce(b.column.isNotNull() & (a.column.isNull() | (a.column < b.column)), F.lit(False))
