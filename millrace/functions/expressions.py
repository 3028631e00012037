"""Aggregation expressions as columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ir import QueryError
from .values import Value, bracket, common_number, document, less, literal, missing, resolve, same


class Scope:
    """The fields and variables that an expression sees."""

    def __init__(self, fields: dict[str, T.DataType], variables: dict[str, Value] | None = None):
        self.fields = fields
        self.variables = getattr(fields, "variables", {}) if variables is None else variables

    def root(self) -> Value:
        return document({name: resolve(self.fields, name) for name in self.fields})

    def path(self, text: str) -> Value:
        if not text.startswith("$$"):
            return resolve(self.fields, text[1:])
        name, _, rest = text[2:].partition(".")
        if name in ("ROOT", "CURRENT"):
            return resolve(self.fields, rest) if rest else self.root()
        if name not in self.variables:
            raise QueryError(f"Use of undefined variable: {name}")
        return resolve({}, rest, self.variables[name]) if rest else self.variables[name]

    def bind(self, name: str, value: Value) -> Scope:
        return Scope(self.fields, self.variables | {name: value})


def evaluate(spec: Any, scope: Scope) -> Value:
    """The value of an expression. Operators are those of OPERATORS."""
    match spec:
        case str() if spec.startswith("$"):
            return scope.path(spec)
        case dict() if len(spec) == 1 and (op := next(iter(spec))).startswith("$"):
            if op == "$literal":
                return literal(spec[op])
            if op not in OPERATORS:
                raise QueryError(f"Unrecognized expression '{op}'")
            return OPERATORS[op](spec[op], scope)
        case dict():
            if odd := next((k for k in spec if k.startswith("$")), None):
                raise QueryError(f"an operator must stand alone: {odd}")
            return document({k: evaluate(v, scope) for k, v in spec.items()})
        case list() | tuple():
            items = [evaluate(x, scope) for x in spec]
            return _array(items)
    return literal(spec)


def _array(items: list[Value]) -> Value:
    kinds = {v.bracket for v in items if v.kind is not None and v.bracket != "null"}
    if len(kinds) > 1:
        raise QueryError("an array of several types has no column type")
    kind = next((v.kind for v in items if v.bracket in kinds), T.NullType())
    if kinds == {"number"}:
        for v in items:
            if v.bracket == "number":
                kind = common_number(kind, v.kind)
    columns = [v.column.cast(kind) if not isinstance(kind, T.NullType) else v.column for v in items]
    return Value(F.array(*columns) if columns else F.array(), T.ArrayType(kind))


def _many(spec: Any, scope: Scope, n: int | None = None) -> list[Value]:
    items = [evaluate(x, scope) for x in (spec if isinstance(spec, list | tuple) else [spec])]
    if n is not None and len(items) != n:
        raise QueryError(f"the expression takes {n} arguments, not {len(items)}")
    return items


def _compare(make: Callable[[Value, Value], Column]):
    return lambda spec, scope: Value(make(*_many(spec, scope, 2)), T.BooleanType())


def truth(v: Value) -> Column:
    """Whether a value counts as true: neither null, nor missing, nor false, nor 0."""
    match v.bracket:
        case "missing" | "null":
            return F.lit(False)
        case "boolean":
            return F.coalesce(v.column, F.lit(False))
        case "number":
            return F.coalesce(v.column != 0, F.lit(False))
    return v.column.isNotNull()


def _arithmetic(name: str, make: Callable[[Column, Column], Column], exact: bool = True):
    def run(spec: Any, scope: Scope) -> Value:
        items = _many(spec, scope)
        if any(v.bracket in ("missing", "null") for v in items):
            return literal(None)
        if odd := next((v for v in items if v.bracket != "number"), None):
            raise QueryError(f"{name} only supports numeric types, not {odd.bracket}")
        out, kind = items[0].column, items[0].kind
        if len(items) == 1:
            kind = common_number(kind, kind)
            out = out.cast(kind)
        for v in items[1:]:
            kind = common_number(kind, v.kind) if exact else T.DoubleType()
            out = make(out.cast(kind), v.column.cast(kind))
        return Value(out, kind)

    return run


def _cond(spec: Any, scope: Scope) -> Value:
    parts = [spec["if"], spec["then"], spec["else"]] if isinstance(spec, dict) else spec
    test, a, b = (evaluate(x, scope) for x in parts)
    if a.bracket in ("missing", "null"):
        a = Value(a.column, b.kind or T.NullType())
    if b.bracket in ("missing", "null"):
        b = Value(b.column, a.kind or T.NullType())
    if a.bracket != b.bracket:
        raise QueryError("the branches of $cond have different types")
    kind = common_number(a.kind, b.kind) if a.bracket == "number" else a.kind
    return Value(F.when(truth(test), a.column.cast(kind)).otherwise(b.column.cast(kind)) if not isinstance(kind, T.NullType) else a.column, kind)


def _if_null(spec: Any, scope: Scope) -> Value:
    items = [v for v in _many(spec, scope) if v.bracket not in ("missing", "null")]
    if not items:
        return literal(None)
    if len({v.bracket for v in items}) > 1:
        raise QueryError("the values of $ifNull have different types")
    kind = items[0].kind
    for v in items[1:]:
        kind = common_number(kind, v.kind) if v.bracket == "number" else kind
    return Value(F.coalesce(*[v.column.cast(kind) for v in items]), kind)


def _cast(kind: T.DataType, name: str):
    def run(spec: Any, scope: Scope) -> Value:
        v = _many(spec, scope, 1)[0]
        if v.bracket in ("missing", "null"):
            return Value(F.lit(None).cast(kind), kind)
        if v.bracket in ("document", "array") or v.bracket == "time" and not isinstance(kind, T.StringType):
            raise QueryError(f"{name} cannot convert a {v.bracket}")
        # text that is no number is an error, as Spark's ANSI cast has it; null stays null
        return Value(v.column.cast(kind), kind)

    return run


def _text(name: str, make: Callable[..., Column], null: str | None = None):
    def run(spec: Any, scope: Scope) -> Value:
        items = _many(spec, scope)
        if any(v.bracket in ("missing", "null") for v in items) and null is None:
            return Value(F.lit(None).cast("string"), T.StringType())
        if odd := next((v for v in items if v.bracket not in ("string", "missing", "null")), None):
            raise QueryError(f"{name} only supports strings, not {odd.bracket}")
        columns = [v.column.cast("string") for v in items]
        return Value(make(*[F.coalesce(c, F.lit(null)) if null is not None else c for c in columns]), T.StringType())

    return run


def _as_array(v: Value, name: str) -> T.ArrayType:
    if not isinstance(v.kind, T.ArrayType):
        raise QueryError(f"{name} needs an array")
    return v.kind


def _filter(spec: dict, scope: Scope) -> Value:
    source = evaluate(spec["input"], scope)
    if source.bracket in ("missing", "null"):
        return literal(None)
    kind = _as_array(source, "$filter")
    name = spec.get("as", "this")
    return Value(F.filter(source.column, lambda x: truth(evaluate(spec["cond"], scope.bind(name, Value(x, kind.elementType))))), kind)


def _map(spec: dict, scope: Scope) -> Value:
    source = evaluate(spec["input"], scope)
    if source.bracket in ("missing", "null"):
        return literal(None)
    element, name = _as_array(source, "$map").elementType, spec.get("as", "this")
    kind = evaluate(spec["in"], scope.bind(name, Value(F.lit(None).cast(element), element))).kind or T.NullType()
    return Value(F.transform(source.column, lambda x: evaluate(spec["in"], scope.bind(name, Value(x, element))).column), T.ArrayType(kind))


def unified(a: T.DataType | None, b: T.DataType | None) -> T.DataType:
    """The least type that holds values of both: whole numbers and floats are floats, nulls any type, documents and lists by their parts."""
    if bracket(a) in ("missing", "null"):
        return b or T.NullType()
    if bracket(b) in ("missing", "null"):
        return a
    if bracket(a) != bracket(b):
        raise QueryError(f"a value that may be a {bracket(a)} and a {bracket(b)} has no column type")
    if bracket(a) == "number":
        return common_number(a, b)
    if isinstance(a, T.ArrayType):
        return T.ArrayType(unified(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = [*a.names, *[n for n in b.names if n not in a.names]]
        return T.StructType([T.StructField(n, unified(a[n].dataType if n in a.names else None, b[n].dataType if n in b.names else None)) for n in names])
    return a


def widened(c: Column, have: T.DataType | None, want: T.DataType) -> Column:
    """A value of one type as one of a type that holds it; fields that it lacks are null."""
    if have is None or isinstance(have, T.NullType):
        return F.lit(None).cast(want)
    if isinstance(want, T.StructType):
        parts = [(widened(c.getField(f.name), have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(want, T.ArrayType):
        return F.transform(c, lambda x: widened(x, have.elementType, want.elementType))
    return c.cast(want)


def _reduce(spec: dict, scope: Scope) -> Value:
    """$reduce. The type of its value has to be known before data is read: it grows, from that of the first value, until a step leaves it as it is."""
    source, first = evaluate(spec["input"], scope), evaluate(spec["initialValue"], scope)
    if source.bracket in ("missing", "null"):
        return literal(None)
    element, kind = _as_array(source, "$reduce").elementType, first.kind or T.NullType()
    step = lambda value, this: evaluate(spec["in"], scope.bind("value", value).bind("this", this))
    for _ in range(32):
        grown = unified(kind, step(Value(F.lit(None).cast(kind), kind), Value(F.lit(None).cast(element), element)).kind)
        if grown == kind:
            break
        kind = grown
    else:
        raise QueryError("the value of $reduce grows without end")
    if isinstance(kind, T.NullType):
        return literal(None)

    def one(value: Column, x: Column) -> Column:
        made = step(Value(value, kind), Value(x, element))
        return widened(made.column, made.kind, kind)

    return Value(F.aggregate(source.column, widened(first.column, first.kind, kind), one), kind)


def _concat_arrays(spec: Any, scope: Scope) -> Value:
    items = _many(spec, scope)
    if any(v.bracket in ("missing", "null") for v in items):
        return literal(None)
    kind: T.DataType = T.NullType()
    for v in items:
        kind = unified(kind, _as_array(v, "$concatArrays").elementType)
    whole = T.ArrayType(kind)
    return Value(F.concat(*[widened(v.column, v.kind, whole) if not isinstance(kind, T.NullType) else v.column for v in items]), whole)


def _reverse(spec: Any, scope: Scope) -> Value:
    v = _many(spec, scope, 1)[0]
    return literal(None) if v.bracket in ("missing", "null") else Value(F.reverse(v.column), _as_array(v, "$reverseArray"))


def _slice(spec: Any, scope: Scope) -> Value:
    """$slice: the first n elements, the last for a negative n, or n from a place, which counts from the end where it is negative."""
    v, *at = _many(spec, scope)
    if v.bracket in ("missing", "null"):
        return literal(None)
    kind, size = _as_array(v, "$slice"), F.size(v.column)
    if len(at) == 1:
        n = at[0].column.cast("int")
        return Value(F.when(n >= 0, F.slice(v.column, F.lit(1), F.greatest(n, F.lit(0)))).otherwise(F.slice(v.column, F.greatest(size + n, F.lit(0)) + 1, size)), kind)
    place, n = (a.column.cast("int") for a in at)
    return Value(F.slice(v.column, F.when(place >= 0, place).otherwise(F.greatest(size + place, F.lit(0))) + 1, n), kind)


def _range(spec: Any, scope: Scope) -> Value:
    items = [v.column.cast("long") for v in _many(spec, scope)]
    low, high, step = items[0], items[1], items[2] if len(items) > 2 else F.lit(1).cast("long")
    some = F.when(step > 0, low < high).otherwise(low > high)
    return Value(F.when(some, F.sequence(low, high - F.signum(step).cast("long"), step)).otherwise(F.array().cast("array<bigint>")), T.ArrayType(T.LongType()))


def _substring(bytes_: bool):
    """$substr: so many characters (or bytes) from a place counted from 0; all that follow for a negative number."""

    def run(spec: Any, scope: Scope) -> Value:
        text, at, n = _many(spec, scope, 3)
        if text.bracket in ("missing", "null"):
            return literal("")
        c = F.coalesce(text.column.cast("string"), F.lit(""))
        start, length = at.column.cast("int"), n.column.cast("int")
        if bytes_:
            raw = F.encode(c, "UTF-8")
            return Value(F.decode(F.substring(raw, start + 1, F.when(length < 0, F.octet_length(c)).otherwise(length)), "UTF-8"), T.StringType())
        return Value(F.substring(c, start + 1, F.when(length < 0, F.char_length(c)).otherwise(length)), T.StringType())

    return run


def _split(spec: Any, scope: Scope) -> Value:
    text, by = _many(spec, scope, 2)
    if text.bracket in ("missing", "null"):
        return literal(None)
    if text.bracket != "string" or by.bracket != "string":
        raise QueryError("$split only supports strings")
    return Value(F.split(text.column, F.concat(F.lit(r"\Q"), by.column, F.lit(r"\E"))), T.ArrayType(T.StringType()))


def _size(spec: Any, scope: Scope) -> Value:
    v = _many(spec, scope, 1)[0]
    _as_array(v, "$size")
    return Value(F.size(v.column).cast("long"), T.LongType())


def _element(spec: Any, scope: Scope) -> Value:
    source, at = _many(spec, scope, 2)
    kind = _as_array(source, "$arrayElemAt").elementType
    return Value(F.try_element_at(source.column, F.when(at.column >= 0, at.column + 1).otherwise(at.column).cast("int")), kind)


def _contains(spec: Any, scope: Scope) -> Value:
    needle, stack = _many(spec, scope, 2)
    element = _as_array(stack, "$in").elementType
    return Value(F.exists(stack.column, lambda x: same(Value(x, element), needle)), T.BooleanType())


def _of_array(name: str):
    """$sum, $avg, $min and $max of the elements of an array, or of several values."""

    def run(spec: Any, scope: Scope) -> Value:
        items = _many(spec, scope)
        v = items[0] if len(items) == 1 and items[0].bracket == "array" else _array(items)
        element = v.kind.elementType
        if name in ("$min", "$max"):
            return Value((F.array_min if name == "$min" else F.array_max)(v.column), element)
        if bracket(element) != "number":
            return literal(0) if name == "$sum" else literal(None)
        kind = T.DoubleType() if name == "$avg" else common_number(element, element)
        full = F.filter(v.column, lambda x: x.isNotNull())
        total = F.aggregate(full, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))
        return Value(F.when(F.size(full) > 0, total / F.size(full)) if name == "$avg" else total, kind)

    return run


def _round(spec: Any, scope: Scope) -> Value:
    items = spec if isinstance(spec, list | tuple) else [spec]
    v = evaluate(items[0], scope)
    if v.bracket in ("missing", "null"):
        return literal(None)
    return Value(F.round(v.column, items[1] if len(items) > 1 else 0), v.kind)


def _unary(make: Callable[[Column], Column], kind: T.DataType | None = None):
    def run(spec: Any, scope: Scope) -> Value:
        v = _many(spec, scope, 1)[0]
        if v.bracket in ("missing", "null"):
            return literal(None)
        if v.bracket != "number":
            raise QueryError(f"a number is needed, not a {v.bracket}")
        return Value(make(v.column), kind or v.kind)

    return run


OPERATORS: dict[str, Callable[[Any, Scope], Value]] = {
    "$eq": _compare(same),
    "$ne": _compare(lambda a, b: ~same(a, b)),
    "$lt": _compare(less),
    "$lte": _compare(lambda a, b: ~less(b, a)),
    "$gt": _compare(lambda a, b: less(b, a)),
    "$gte": _compare(lambda a, b: ~less(a, b)),
    "$and": lambda spec, scope: Value(_all([truth(v) for v in _many(spec, scope)], True), T.BooleanType()),
    "$or": lambda spec, scope: Value(_all([truth(v) for v in _many(spec, scope)], False), T.BooleanType()),
    "$not": lambda spec, scope: Value(~truth(_many(spec, scope, 1)[0]), T.BooleanType()),
    "$add": _arithmetic("$add", lambda a, b: a + b),
    "$subtract": _arithmetic("$subtract", lambda a, b: a - b),
    "$multiply": _arithmetic("$multiply", lambda a, b: a * b),
    "$divide": _arithmetic("$divide", lambda a, b: F.try_divide(a, b), exact=False),
    "$mod": _arithmetic("$mod", lambda a, b: F.try_mod(a, b)),
    "$abs": _unary(F.abs),
    "$ceil": _unary(F.ceil, T.LongType()),
    "$floor": _unary(F.floor, T.LongType()),
    "$sqrt": _unary(F.sqrt, T.DoubleType()),
    "$round": _round,
    "$cond": _cond,
    "$ifNull": _if_null,
    "$toInt": _cast(T.IntegerType(), "$toInt"),
    "$toLong": _cast(T.LongType(), "$toLong"),
    "$toDouble": _cast(T.DoubleType(), "$toDouble"),
    "$toString": _cast(T.StringType(), "$toString"),
    "$concat": _text("$concat", F.concat),
    "$toLower": _text("$toLower", F.lower, ""),
    "$toUpper": _text("$toUpper", F.upper, ""),
    "$filter": _filter,
    "$map": _map,
    "$size": _size,
    "$reduce": _reduce,
    "$concatArrays": _concat_arrays,
    "$reverseArray": _reverse,
    "$slice": _slice,
    "$range": _range,
    "$substr": _substring(True),
    "$substrBytes": _substring(True),
    "$substrCP": _substring(False),
    "$split": _split,
    "$strLenCP": lambda spec, scope: Value(F.char_length(_text("$strLenCP", lambda c: c)(spec, scope).column).cast("long"), T.LongType()),
    "$arrayElemAt": _element,
    "$in": _contains,
    "$sum": _of_array("$sum"),
    "$avg": _of_array("$avg"),
    "$min": _of_array("$min"),
    "$max": _of_array("$max"),
}


def _all(columns: list[Column], every: bool) -> Column:
    out = F.lit(every)
    for c in columns:
        out = (out & c) if every else (out | c)
    return out


__all__ = ["OPERATORS", "Scope", "evaluate", "missing", "truth"]
