"""Filters (of find, count_documents, distinct and $match) as columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import Scope, evaluate, truth
from ..functions.values import Value, bracket, literal, resolve
from ..plans.ir import Chain, QueryError

#: Turns a chain that stands for a value into a column; given by the compiler.
Scalar = Callable[[Chain], Value]


def condition(spec: Any, fields: dict[str, T.DataType], scalar: Scalar) -> Column:
    """Whether a document meets a filter. Plain comparisons stay plain, so that scans can take them."""
    if not isinstance(spec, dict):
        raise QueryError("a filter must be a document")
    parts = []
    for key, test in spec.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(test, list) or not test:
                raise QueryError(f"{key} needs a list of filters")
            each = [condition(t, fields, scalar) for t in test]
            joined = reduce(lambda a, b: a & b, each) if key == "$and" else reduce(lambda a, b: a | b, each)
            parts.append(~F.coalesce(joined, F.lit(False)) if key == "$nor" else joined)
        elif key == "$expr":
            parts.append(truth(evaluate(test, Scope(fields))))
        elif key.startswith("$"):
            raise QueryError(f"unknown top level operator: {key}")
        else:
            parts.append(_field(resolve(fields, key), test, scalar))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _field(at: Value, test: Any, scalar: Scalar) -> Column:
    if isinstance(test, dict) and test and all(k.startswith("$") for k in test):
        return reduce(lambda a, b: a & b, [_test(at, op, arg, scalar) for op, arg in test.items() if op != "$options"])
    return _test(at, "$eq", test, scalar)


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _test(at: Value, op: str, arg: Any, scalar: Scalar) -> Column:
    if op == "$not":
        return ~_known(_field(at, arg, scalar))
    if op == "$ne":
        if isinstance(arg, Chain) or isinstance(at.kind, T.ArrayType) or isinstance(arg, list | dict):
            return ~_known(_test(at, "$eq", arg, scalar))
        if arg is None:
            return at.column.isNotNull() if at.kind is not None else F.lit(False)
        if at.bracket != literal(arg).bracket:
            return F.lit(True)
        return ~at.column.eqNullSafe(literal(arg).column)
    if op == "$nin":
        return ~_known(_test(at, "$in", arg, scalar))
    if op == "$in":
        if not isinstance(arg, list | tuple):
            raise QueryError("$in needs an array")
        return reduce(lambda a, b: a | b, [_test(at, "$eq", x, scalar) for x in arg], F.lit(False)) if _mixed(at, arg) else at.column.isin([literal(x).column for x in arg])
    if op == "$all":
        if not isinstance(arg, list | tuple):
            raise QueryError("$all needs an array")
        each = [_known(_test(at, "$elemMatch", x["$elemMatch"], scalar) if isinstance(x, dict) and list(x) == ["$elemMatch"] else _test(at, "$eq", x, scalar)) for x in arg]
        return reduce(lambda a, b: a & b, each) if each else F.lit(False)
    if op == "$exists":
        return _exists(at) if arg else ~_exists(at)
    if op == "$size":
        return (F.size(at.column) == arg) if isinstance(at.kind, T.ArrayType) else F.lit(False)
    if op == "$elemMatch":
        if not isinstance(at.kind, T.ArrayType):
            return F.lit(False)
        element = at.kind.elementType
        if isinstance(element, T.StructType) and not all(k.startswith("$") for k in arg):
            return F.exists(at.column, lambda x: _known(reduce(lambda a, b: a & b, [_field(resolve({}, k, Value(x, element)), t, scalar) for k, t in arg.items()])))
        return F.exists(at.column, lambda x: _known(_field(Value(x, element), arg, scalar)))
    if op == "$regex":
        return _any(at, lambda v: v.column.rlike(arg) if v.bracket == "string" else F.lit(False))
    if op not in ("$eq", "$gt", "$gte", "$lt", "$lte"):
        raise QueryError(f"unknown operator: {op}")
    value = scalar(arg) if isinstance(arg, Chain) else literal(list(arg) if isinstance(arg, tuple) else arg)
    if isinstance(at.kind, T.ArrayType) and value.bracket == "array":
        return F.size(at.column) == 0 if op == "$eq" and not arg else _order(at, op, value)
    return _any(at, lambda v: _order(v, op, value))


def _mixed(at: Value, items: Any) -> bool:
    """Whether a list of values needs a test each, rather than one lookup."""
    return isinstance(at.kind, T.ArrayType) or not items or any(isinstance(x, Chain) or x is None or literal(x).bracket != at.bracket for x in items)


def _any(at: Value, test: Callable[[Value], Column]) -> Column:
    """A test of a value or, over an array, of any of its elements."""
    if isinstance(at.kind, T.ArrayType):
        return F.exists(at.column, lambda x: _known(test(Value(x, at.kind.elementType))))
    return test(at)


def _order(v: Value, op: str, value: Value) -> Column:
    """Comparison within a bracket; other brackets never meet. Null equals null and missing."""
    if value.bracket == "null":
        return (v.column.isNull() if v.kind is not None else F.lit(True)) if op in ("$eq", "$gte", "$lte") else F.lit(False)
    if v.bracket != value.bracket or bracket(v.kind) == "other":
        return F.lit(False)
    a, b = v.column, value.column
    return {"$eq": a == b, "$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op]


def _exists(at: Value) -> Column:
    """Whether a document has the field; below an array some element must have it."""
    if at.kind is None:
        return F.lit(False)
    if at.some is not None:
        return at.some
    return F.lit(True) if at.present is None else at.present
