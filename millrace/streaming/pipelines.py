"""Pipelines over streaming DataFrames.

Stages are DataFrame transformations, so those that need no order of all rows
apply to a stream as they do to a table: filters, projections, computed fields,
unwinding, lookups in collections of a catalog, and groups (for sinks in
complete or update mode). Three stages more are of event time, and make a state
that ends: a window closes when the watermark has passed its end.

``{'$tumblingWindow': {'time': '$ts', 'interval': {'size': 1, 'unit': 'hour'}, 'allowedLateness': {...}, 'pipeline': [...]}}``
``{'$hoppingWindow': {..., 'hop': {...}}}`` ``{'$sessionWindow': {'time': ..., 'gap': {...}, 'partitionBy': ..., ...}}``
``{'$dropDuplicates': {'time': ..., 'on': [...], 'allowedLateness': {...}}}``

The pipeline of a window is filters and computed fields, then a group, and what
may follow a group; its documents get windowStart and windowEnd. The same text
over a table gives what the stream gives in the end, but for what comes too late.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import Scope, evaluate
from ..functions.values import Value, quoted
from ..operators.frame import CARRIED, Frame
from ..plans.compiler import Compiler
from ..plans.ir import QueryError
from ..sources.catalog import Catalog

#: Stages that rank or count all rows, which a stream never has.
UNBOUNDED = {"$sort", "$limit", "$skip", "$unionWith", "$setWindowFields", "$facet", "$bucketAuto", "$graphLookup"}
#: Units of intervals.
UNITS = {"ms": "milliseconds", "second": "seconds", "minute": "minutes", "hour": "hours", "day": "days"}
#: How late an event may be where nothing is said.
LATENESS = "0 seconds"
WINDOWS = {"$tumblingWindow", "$hoppingWindow", "$sessionWindow"}


def attach(stream: DataFrame, stages: list[dict], catalog: Catalog | None = None, database: str = "") -> DataFrame:
    """``stream``, or a table, after the stages of a pipeline; lookups go to the collections of ``database``."""
    if stream.isStreaming and (odd := next((op for s in stages for op in s if op in UNBOUNDED), None)):
        raise QueryError(f"{odd} needs all rows, which a stream never has")
    compiler = Compiler(catalog or Catalog(stream.sparkSession), database)
    frame, plain, marks = Frame(stream), [], {}
    for stage in stages:
        ((op, spec),) = stage.items()
        if op not in WINDOWS | {"$dropDuplicates"}:
            plain.append(stage)
            continue
        frame, plain = compiler.pipeline(frame, plain), []
        frame = _once(frame, spec, marks) if op == "$dropDuplicates" else _windowed(frame, op, spec, compiler, marks)
    return compiler.pipeline(frame, plain).visible()


def _interval(spec: Any) -> str:
    if not isinstance(spec, dict) or spec.get("unit") not in UNITS or not isinstance(spec.get("size"), int) or spec["size"] < 0:
        raise QueryError("an interval is a size and a unit")
    return f"{spec['size']} {UNITS[spec['unit']]}"


def _timed(frame: Frame, spec: dict, marks: dict[str, str]) -> tuple[DataFrame, str]:
    """The rows with the watermark of a stage, and the name of their time. A stream has one watermark (``marks``), which later stages share."""
    path = spec.get("time")
    at = evaluate(path, Scope(frame.fields)) if isinstance(path, str) else None
    if at is None or not isinstance(at.kind, T.TimestampType | T.TimestampNTZType):
        raise QueryError("a stage of event time needs the path of a time")
    late = _interval(spec["allowedLateness"]) if "allowedLateness" in spec else LATENESS
    name = path[1:] if path[1:] in frame.fields else "__time"
    df = frame.df if name != "__time" else frame.df.withColumn(name, at.column)
    if not df.isStreaming:
        return df, name
    if marks and marks != {name: late}:
        raise QueryError("stages of event time on one stream share their time and lateness")
    if not marks:
        df = df.withWatermark(name, late)
    marks[name] = late
    return df, name


def _once(frame: Frame, spec: dict, marks: dict[str, str]) -> Frame:
    """The first event of each value of some fields; the state of a value ends with the watermark."""
    df, _ = _timed(frame, spec, marks)
    on = spec.get("on")
    if not isinstance(on, list) or not on or any(n not in frame.fields for n in on):
        raise QueryError("$dropDuplicates needs fields")
    kept = df.dropDuplicatesWithinWatermark(on) if df.isStreaming else df.dropDuplicates(on)
    return frame.of(kept.drop("__time"))


def _windowed(frame: Frame, op: str, spec: dict, compiler: Compiler, marks: dict[str, str]) -> Frame:
    df, time = _timed(frame, spec, marks)
    at: Column
    if op == "$sessionWindow":
        at = F.session_window(time, _interval(spec.get("gap")))
    else:
        size = _interval(spec.get("interval"))
        at = F.window(time, size, _interval(spec["hop"])) if op == "$hoppingWindow" else F.window(time, size)
    begun = Frame(df.where(F.col(quoted(time)).isNotNull()))
    inner = list(spec.get("pipeline") or [])
    place = next((i for i, s in enumerate(inner) if next(iter(s)) == "$group"), None)
    if place is None or any(next(iter(s)) not in ("$match", "$addFields", "$set", "$unwind", "$unset") for s in inner[:place]):
        raise QueryError("the pipeline of a window is filters and fields, a group, and what follows")
    begun = compiler.pipeline(begun, inner[:place])
    columns = {f"{CARRIED}window": at}
    if "partitionBy" in spec:
        columns[f"{CARRIED}key"] = evaluate(spec["partitionBy"], Scope(begun.fields)).column
    ended = compiler.pipeline(begun.of(begun.df.withColumns(columns)), inner[place:])
    parts = {"windowStart": Value(F.col(f"{CARRIED}window.start"), T.TimestampType()), "windowEnd": Value(F.col(f"{CARRIED}window.end"), T.TimestampType())}
    shown = ended.show(ended.values() | parts)
    return Frame(shown.df.drop(*[c for c in shown.df.columns if c.startswith(CARRIED)]))
