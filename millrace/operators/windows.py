"""$setWindowFields: fields that look at the documents around a document.

A partition may be one key, or all documents, so none is taken to fit into a
task. Whole-partition outputs are grouped and joined back. Running outputs are
made over ranges of (partition, order): each range by itself, and for the
partitions that go on over the end of a range what the ranges before add up to.
Ranks are running counts of the different values. Frames of so many documents
before and behind are made in stretches of numbered documents that overlap by
the frame. Frames by value, or open on one side only, take a partition as one
window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import Scope, evaluate
from ..functions.values import Value, common_number, literal, quoted
from ..plans.ir import QueryError
from ..session import stored
from .frame import HIDDEN, Frame

#: Documents in a stretch at least, where a partition is cut by their numbers.
STRETCH = 1 << 16
#: The units of frames by time, in microseconds.
UNITS = {"millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
RANKS = {"$rank", "$denseRank"}


@dataclass(frozen=True)
class Output:
    """One output: its operator, its argument's value, and its frame."""

    name: str
    op: str
    value: Value | None
    frame: tuple[Any, Any] | None  # by documents; None: see range
    range: tuple[Any, Any] | None = None
    by: int = 0  # of $shift
    default: Any = None
    weight: float = 0.0  # of $expMovingAvg


def window_fields(frame: Frame, spec: dict, context: Any = None, sort_keys: Callable[[Frame, Any], list] | None = None) -> Frame:
    """The documents with the outputs of a $setWindowFields; those of equal sort keys are in the collection's order."""
    if not isinstance(spec, dict) or not isinstance(spec.get("output"), dict):
        raise QueryError("$setWindowFields needs an output")
    scope = Scope(frame.fields)
    ordered = bool(spec.get("sortBy"))
    keys = sort_keys(frame, spec["sortBy"]) if ordered else []
    part = evaluate(spec.get("partitionBy"), scope)
    empty = part.bracket in ("missing", "null")
    outputs = [_output(n, a, scope, spec.get("sortBy") or {}) for n, a in spec["output"].items()]
    df = frame.df.withColumn("__p", F.lit(None).cast("string") if empty else part.column)
    df = df.withColumns({f"__s{i}": c for i, (c, _) in enumerate(keys)})
    df = df.withColumns({f"__v_{o.name}": _argument(o) for o in outputs if o.value is not None and o.value.kind is not None})
    by = [*frame.carried, "__p"]
    order = [F.col(f"__s{i}") if up else F.col(f"__s{i}").desc() for i, (_, up) in enumerate(keys)]
    place = [*order, *[F.col(c) if not c.startswith(f"{HIDDEN}d") else F.col(c).desc() for c in frame.hidden]] or [F.lit(0)]
    made: dict[str, Value] = {}
    kinds: dict[str, list[Output]] = {}
    for o in outputs:
        if o.value is not None and o.value.kind is None and o.op not in ("$sum", "$push", "$addToSet"):
            made[o.name] = literal(None)
            continue
        kinds.setdefault(_way(o, ordered), []).append(o)
    if some := kinds.get("whole"):
        df = _whole(df, by, some)
    if some := kinds.get("rank"):
        df = _ranks(df, by, [f"__s{i}" for i in range(len(keys))], order, some)
    if (some := kinds.get("running", [])) or kinds.get("near"):
        number = [Output("__number", "$documentNumber", None, ("unbounded", "current"))] if kinds.get("near") else []
        df = _running(df, by, place, [*some, *number])
    if some := kinds.get("near"):
        df = _near(df, by, some)
    if some := kinds.get("average"):
        for o in some:
            df = _moving(df, by, place, o)
    if some := kinds.get("plain"):
        window = Window.partitionBy(*by).orderBy(*place)
        df = df.withColumns({f"__o_{o.name}": _filled(o, window, df) if o.op == "$linearFill" else _finished(o, _aggregate(o).over(_framed(o, window, by, df))) for o in some})
    for o in outputs:
        if o.name not in made:
            kind = df.schema[f"__o_{o.name}"].dataType
            made[o.name] = Value(F.col(quoted(f"__o_{o.name}")).cast(kind), kind)
    return frame.show(frame.values() | made, df, sorted=False)


def _output(name: str, spec: Any, scope: Scope, sort: dict) -> Output:
    if not isinstance(spec, dict) or "." in name:
        raise QueryError("an output is one top-level field with one operator")
    window = spec.get("window")
    ops = [k for k in spec if k != "window"]
    if len(ops) != 1:
        raise QueryError("an output is one top-level field with one operator")
    op, arg = ops[0], spec[ops[0]]
    if op not in {*AGGREGATES, *RANKS, "$documentNumber", "$shift", "$locf", "$linearFill", "$expMovingAvg"}:
        raise QueryError(f"unknown window operator '{op}'")
    if op in {*RANKS, "$documentNumber", "$shift", "$locf", "$linearFill", "$expMovingAvg"} and window is not None:
        raise QueryError(f"{op} takes no window")
    if op in {*RANKS, "$documentNumber", "$shift", "$expMovingAvg", "$linearFill"} and not sort or op in {*RANKS, "$linearFill"} and len(sort) != 1:
        raise QueryError(f"{op} needs a sortBy{' of one field' if op in RANKS else ''}")
    if op in RANKS or op in ("$documentNumber", "$count"):
        value = None
    elif op == "$shift":
        return Output(name, op, evaluate(arg["output"], scope), (-abs(arg["by"]), abs(arg["by"])), by=int(arg["by"]), default=arg.get("default"))
    elif op == "$expMovingAvg":
        weight = arg["alpha"] if "alpha" in arg else 2 / (arg["N"] + 1)
        return Output(name, op, evaluate(arg["input"], scope), None, weight=float(weight))
    else:
        value = evaluate(arg, scope)
    if op == "$locf" or op in RANKS or op == "$documentNumber":
        return Output(name, op, value, ("unbounded", "current"))
    if op == "$linearFill":
        return Output(name, op, value, None, ("unbounded", "unbounded"))
    window = window or {"documents": ["unbounded", "unbounded"]}
    for how in ("documents", "range"):
        if how in window:
            low, high = window[how]
            if any(not (b in ("unbounded", "current") or isinstance(b, int | float) and not isinstance(b, bool)) for b in (low, high)):
                raise QueryError("a frame's ends are numbers, 'unbounded' or 'current'")
            if how == "range" and (low, high) != ("unbounded", "unbounded"):
                if list(sort.values()) != [1]:
                    raise QueryError("a frame by value needs a sortBy of one ascending field")
                unit = UNITS.get(window["unit"]) if "unit" in window else 1
                if unit is None:
                    raise QueryError(f"unknown unit {window['unit']}")
                return Output(name, op, value, None, tuple(b if isinstance(b, str) else b * unit for b in (low, high)))
            if not sort and (low, high) != ("unbounded", "unbounded"):
                raise QueryError("a frame needs a sortBy")
            return Output(name, op, value, (low, high))
    raise QueryError("a window has documents or range")


#: The aggregates of frames, over a column.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max, "$count": F.count, "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp,
    "$first": F.first, "$last": F.last, "$push": F.collect_list, "$addToSet": F.collect_set,
}


def _argument(o: Output) -> Column:
    v = o.value
    if o.op in ("$sum", "$avg", "$stdDevPop", "$stdDevSamp", "$expMovingAvg", "$linearFill"):
        if v.bracket != "number":
            return F.lit(None).cast("long")
        return v.column.cast(common_number(v.kind, v.kind) if o.op == "$sum" else T.DoubleType())
    return v.column


def _aggregate(o: Output) -> Column:
    """The aggregate of an output, before its frame is given."""
    c = F.col(quoted(f"__v_{o.name}")) if o.value is not None and o.value.kind is not None else F.lit(None)
    if o.op == "$count":
        return F.count(F.lit(1))
    if o.op in ("$push", "$addToSet"):  # lists drop bare nulls, and so what is missing
        one = F.struct(c.alias("v"))
        return AGGREGATES[o.op](one if o.value.present is None and o.value.kind is not None else F.when(o.value.present if o.value.kind is not None else F.lit(False), one))
    return AGGREGATES[o.op](c)


def _finished(o: Output, c: Column) -> Column:
    if o.op in ("$push", "$addToSet"):
        return F.transform(c, lambda x: x["v"])
    return F.coalesce(c, F.lit(0)) if o.op == "$sum" else c


def _way(o: Output, ordered: bool) -> str:
    """How an output is made."""
    if o.op in RANKS:
        return "rank"
    if o.op == "$expMovingAvg":
        return "average"
    if o.frame is None:
        return "plain"
    low, high = o.frame
    if (low, high) == ("unbounded", "unbounded"):
        return "whole" if o.op not in ("$push", "$first", "$last") else "plain"
    if (low, high) == ("unbounded", "current") and o.op in RUNNING:
        return "running"
    return "near" if "unbounded" not in o.frame else "plain"


def _filled(o: Output, window: Any, df: DataFrame) -> Column:
    """A null between two values: what lies on the line between them at its sort key."""
    at = F.col("__s0").cast("double") if isinstance(df.schema["__s0"].dataType, T.NumericType) else F.unix_micros(F.col("__s0").cast("timestamp")).cast("double")
    c = F.col(quoted(f"__v_{o.name}"))
    known = F.when(c.isNotNull(), F.struct(at.alias("x"), c.alias("y")))
    a = F.last(known, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(known, ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(c, a["y"] + (at - a["x"]) * F.try_divide(b["y"] - a["y"], b["x"] - a["x"]))


def _framed(o: Output, window: Any, by: list[str], df: DataFrame) -> Any:
    if o.frame == ("unbounded", "unbounded"):
        return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bound = lambda b, open_: open_ if b == "unbounded" else 0 if b == "current" else b
    if o.frame is not None:
        return window.rowsBetween(bound(o.frame[0], Window.unboundedPreceding), bound(o.frame[1], Window.unboundedFollowing))
    at = F.col("__s0") if isinstance(df.schema["__s0"].dataType, T.NumericType) else F.unix_micros(F.col("__s0").cast("timestamp"))
    low, high = bound(o.range[0], Window.unboundedPreceding), bound(o.range[1], Window.unboundedFollowing)
    return Window.partitionBy(*by).orderBy(at).rangeBetween(low, high)


def joined(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """A join on equal columns, null to null; the right side's are dropped."""
    other = right.withColumnsRenamed({c: f"__r{i}" for i, c in enumerate(by)})
    made = left.join(other, [F.col(c).eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate(by)], how)
    return made if how == "left_semi" else made.drop(*[f"__r{i}" for i in range(len(by))])


def _whole(df: DataFrame, by: list[str], outputs: list[Output]) -> DataFrame:
    """Aggregates of whole partitions, one row each, joined back."""
    per = df.groupBy(*by).agg(*[_finished(o, _aggregate(o)).alias(f"__o_{o.name}") for o in outputs])
    return joined(df, per, by)


#: Running outputs: the column of a range, over its frame, and how what went before is added to it.
RUNNING: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "$sum": (F.sum, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "$count": (F.count, F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))),
    "$documentNumber": (F.count, F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))),
    "$min": (F.min, F.min, F.least),
    "$max": (F.max, F.max, F.greatest),
    "$locf": (lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True), F.coalesce),
    "$avg": (lambda c: F.struct(F.sum(c).alias("s"), F.count(c).alias("n")), None, None),
}


def _running(df: DataFrame, by: list[str], place: list[Column], outputs: list[Output]) -> DataFrame:
    """Outputs over all documents of the partition up to each."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    parts: list[tuple[str, str, Column]] = []  # a running column: its name, what it is, and what it is of
    for o in outputs:
        c = F.col(quoted(f"__v_{o.name}")) if o.value is not None and o.value.kind is not None else F.lit(None).cast("long") if o.value is not None else F.lit(1)
        parts += [(f"__sum_{o.name}", "$sum", c), (f"__n_{o.name}", "$count", c)] if o.op == "$avg" else [(f"__run_{o.name}", o.op, c)]
    # ranges are a sample's, and have to stay
    dealt = stored(df.repartitionByRange(n, *by, *place).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part", *by).orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumns({name: RUNNING[op][0](c).over(within) for name, op, c in parts} | {"__at": F.count(F.lit(1)).over(within)})
    # partitions of more than one range: as many rows as there are ends of ranges
    many = dealt.select("__part", *by).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("__ranges")).where("__ranges > 1").drop("__ranges")
    ends = (joined(local, many, by, "left_semi") if by else local).groupBy("__part", *by).agg(F.max_by(F.struct(*[name for name, _, _ in parts]), "__at").alias("__end"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__part", *by, *[RUNNING[op][1](F.col(f"__end.{name}")).over(before).alias(f"__before{name}") for name, op, _ in parts])
    both = joined(local, carried, ["__part", *by])
    total = {name: RUNNING[op][2](F.col(name), F.col(f"__before{name}")) for name, op, _ in parts}
    made = {f"__o_{o.name}": total[f"__sum_{o.name}"] / F.nullif(total[f"__n_{o.name}"], F.lit(0)) if o.op == "$avg" else _finished(o, total[f"__run_{o.name}"]) for o in outputs}
    return both.withColumns(made).drop("__part", "__at", *[x for name, _, _ in parts for x in (name, f"__before{name}")])


def _ranks(df: DataFrame, by: list[str], names: list[str], order: list[Column], outputs: list[Output]) -> DataFrame:
    """Ranks: a running count over the different sort keys of a partition, however many documents share one."""
    values = df.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("__same")).withColumn("__v___before", F.col("__same"))
    counts = [Output("__before", "$sum", Value(F.col("__same"), T.LongType()), ("unbounded", "current")), Output("__dense", "$documentNumber", None, ("unbounded", "current"))]
    ranked = _running(values, by, order, counts)
    made = {"$rank": F.col("__o___before") - F.col("__same") + 1, "$denseRank": F.col("__o___dense")}
    return joined(df, ranked.select(*by, *names, *[made[o.op].alias(f"__o_{o.name}") for o in outputs]), [*by, *names])


def _near(df: DataFrame, by: list[str], outputs: list[Output]) -> DataFrame:
    """Frames of so many documents: stretches of numbered documents, each with those of its neighbours that its frames reach."""
    bound = lambda b: 0 if b == "current" else int(b)
    reach = max(abs(bound(b)) for o in outputs for b in o.frame)
    size = max(STRETCH, 4 * reach)
    number = F.col("__o___number")
    stretches = F.array_distinct(F.transform(F.array(number - reach, number, number + reach), lambda x: F.floor(x / size)))
    laid = df.withColumn("__home", F.floor(number / size)).withColumn("__stretch", F.explode(stretches))
    window = Window.partitionBy(*by, "__stretch").orderBy("__o___number")
    made = {}
    for o in outputs:
        c = F.col(quoted(f"__v_{o.name}")) if o.value is not None and o.value.kind is not None else F.lit(None)
        if o.op == "$shift":
            made[f"__o_{o.name}"] = F.lead(c, o.by, o.default).over(window) if o.by >= 0 else F.lag(c, -o.by, o.default).over(window)
        else:
            made[f"__o_{o.name}"] = _finished(o, _aggregate(o).over(window.rowsBetween(bound(o.frame[0]), bound(o.frame[1]))))
    return laid.withColumns(made).where("__stretch = __home").drop("__home", "__stretch")


def _moving(df: DataFrame, by: list[str], place: list[Column], o: Output) -> DataFrame:
    """$expMovingAvg: of each range as if it were the first, and as if the average before it were 0, so that the true one can be put in."""
    spark, rest = df.sparkSession, 1 - o.weight
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = stored(df.repartitionByRange(n, *by, *place).withColumn("__part", F.spark_partition_id()))
    numbered = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__part", *by).orderBy(*place)))
    value = f"__v_{o.name}"
    kind = T.StructType([*numbered.schema, T.StructField("__first", T.DoubleType()), T.StructField("__zero", T.DoubleType()), T.StructField("__count", T.LongType())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("__at")
        x = t[value].to_numpy()
        first, zero, seen, y, z, k = np.empty(len(x)), np.empty(len(x)), np.empty(len(x), np.int64), np.nan, 0.0, 0
        for i, v in enumerate(x):
            if not np.isnan(v):
                y = v if k == 0 else v * (1 - rest) + y * rest
                z, k = v * (1 - rest) + z * rest, k + 1
            first[i], zero[i], seen[i] = y, z, k
        out = {"__first": pa.array(first, from_pandas=True), "__zero": pa.array(zero), "__count": pa.array(seen)}
        for name, column in out.items():
            t = t.append_column(name, column)
        return t

    local = stored(numbered.groupBy("__part", *by).applyInArrow(run, kind))
    ends = local.groupBy("__part", *by).agg(*[F.max_by(c, "__at").alias(c) for c in ("__first", "__zero", "__count")])
    many = ends.groupBy(*by).agg(F.count(F.lit(1)).alias("__ranges")).where("__ranges > 1").drop("__ranges")
    spanning = joined(ends, many, by, "left_semi")

    def fold(t: pd.DataFrame) -> pd.DataFrame:  # a row for each range of the partition
        t, before, out = t.sort_values("__part"), None, []
        for row in t.itertuples(index=False):
            at = dict(zip(t.columns, row, strict=True))
            out.append(before)
            if at["__count"]:
                before = at["__first"] if before is None else at["__zero"] + rest ** at["__count"] * before
        return t[["__part", *by]].assign(__before=pd.Series(out, index=t.index, dtype="float64"))

    shape = T.StructType([*[f for f in spanning.schema if f.name in ("__part", *by)], T.StructField("__before", T.DoubleType())])
    carried = spanning.groupBy(*by).applyInPandas(fold, T.StructType([shape["__part"], *[shape[c] for c in by], shape["__before"]]))
    both = joined(local, carried.withColumn("__before", F.nanvl("__before", F.lit(None).cast("double"))), ["__part", *by])
    true = F.when(F.col("__before").isNull(), F.col("__first")).otherwise(F.col("__zero") + F.pow(F.lit(rest), F.col("__count")) * F.col("__before"))
    shown = F.when(F.col(quoted(value)).isNotNull(), true)
    return both.withColumn(f"__o_{o.name}", shown).drop("__part", "__at", "__first", "__zero", "__count", "__before")


def cut_points(df: DataFrame, column: str, first: Callable[[int], int], then: Callable[[int, int], int | None]) -> list[tuple[Any, int]]:
    """Exact cuts of a column in ascending order: the least value up to which at least so many rows lie, and how many do.

    ``first`` gives from the number of all rows the place to look for first,
    ``then`` from the number of all and of those up to the last cut the next
    one, or None. Different values are counted once and summed up along their
    order; each cut is a lookup in that sorted table, which statistics of its
    files narrow to the range that holds it.
    """
    values = df.groupBy(F.col(column).alias("__x")).agg(F.count(F.lit(1)).alias("__same")).withColumn("__v_upto", F.col("__same"))
    table = stored(_running(values, [], [F.col("__x")], [Output("upto", "$sum", Value(F.col("__same"), T.LongType()), ("unbounded", "current"))]).select("__x", F.col("__o_upto").alias("upto")))
    n = table.agg(F.max("upto")).first()[0]
    out: list[tuple[Any, int]] = []
    at = first(n) if n else None
    while at is not None:
        found = table.where(F.col("upto") >= min(at, n)).agg(F.min_by(F.struct("__x", "upto"), "upto")).first()[0]
        out.append((found["__x"], found["upto"]))
        at = then(n, found["upto"])
    return out


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[Any]:
    """The least values up to which at least each share of the rows with a value lies; None for all where there is none."""
    full = df.where(F.col(column).isNotNull())
    left = sorted(set(shares))
    found: dict[float, Any] = {}
    for share in left:  # ascending shares, of one table
        found[share] = None
    rest = iter(left)
    cuts = cut_points(full, column, lambda n: max(1, -int(-n * next(rest) // 1)), lambda n, upto: None if (s := next(rest, None)) is None else max(1, -int(-n * s // 1)))
    for share, (x, _) in zip(left, cuts, strict=False):
        found[share] = x
    return [found[s] for s in shares]
