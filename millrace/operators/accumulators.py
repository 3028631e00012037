"""Accumulators of $group as aggregate columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import Scope, evaluate
from ..functions.values import Value, common_number, literal
from ..plans.ir import QueryError


def accumulate(spec: Any, scope: Scope, order: Column | None) -> Value:
    """The aggregate of one field of a group; ``order`` ranks the rows for $first and $last."""
    if not isinstance(spec, dict) or len(spec) != 1:
        raise QueryError("a field of $group must be one accumulator")
    ((op, arg),) = spec.items()
    if op == "$count":
        return Value(F.count(F.lit(1)), T.LongType())
    v = evaluate(arg, scope)
    if op == "$sum":
        if not isinstance(arg, str | dict | list):  # a number for each document
            return Value(F.coalesce(F.sum(v.column), v.column - v.column), v.kind) if v.bracket == "number" and arg != 1 else Value(F.count(F.lit(1)), T.LongType())
        if v.bracket != "number":
            return literal_aggregate(0)
        kind = common_number(v.kind, v.kind)
        return Value(F.coalesce(F.sum(v.column.cast(kind)), F.lit(0).cast(kind)), kind)
    if op == "$avg":
        return Value(F.avg(v.column), T.DoubleType()) if v.bracket == "number" else literal_aggregate(None)
    if v.kind is None and op in ("$min", "$max", "$first", "$last"):
        return literal_aggregate(None)
    if op in ("$min", "$max"):
        return Value((F.min if op == "$min" else F.max)(v.column), v.kind)
    if op in ("$first", "$last"):
        if order is None:
            return Value((F.first if op == "$first" else F.last)(v.column), v.kind)
        # the order is a struct, so that null keys rank too
        return Value((F.min_by if op == "$first" else F.max_by)(v.column, order), v.kind)
    if op == "$push":
        if v.kind is None:
            return Value(F.array_compact(F.collect_list(F.lit(None).cast("string"))), T.ArrayType(T.StringType()))
        there = lambda c: c if v.present is None else F.when(v.present, c)  # noqa: E731 - a list drops bare nulls, and so what is missing
        wrapped = F.collect_list(there(F.struct(v.column.alias("v"))))
        if order is not None:
            wrapped = F.array_sort(F.collect_list(there(F.struct(order.alias("o"), v.column.alias("v")))))
        return Value(F.transform(wrapped, lambda x: x["v"]), T.ArrayType(v.kind))
    if op == "$addToSet":
        if v.kind is None:
            return Value(F.collect_set(F.lit(None).cast("string")), T.ArrayType(T.StringType()))
        one = F.struct(v.column.alias("v"))
        return Value(F.transform(F.collect_set(one if v.present is None else F.when(v.present, one)), lambda x: x["v"]), T.ArrayType(v.kind))
    if op in ("$stdDevPop", "$stdDevSamp"):
        return Value((F.stddev_pop if op == "$stdDevPop" else F.stddev_samp)(v.column), T.DoubleType()) if v.bracket == "number" else literal_aggregate(None)
    raise QueryError(f"unknown group operator '{op}'")


def literal_aggregate(x: int | None) -> Value:
    """A constant that may stand among aggregates."""
    v = literal(x)
    return Value(F.max(v.column), v.kind if x is not None else T.NullType())
