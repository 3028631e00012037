"""Results as JSON-safe values, and whether two results are the same."""

from __future__ import annotations

from collections import Counter
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import Result


def scored_value(result: Result, strict: bool = False) -> Any:
    """A result as the scoring sees it. A document counts as the list of its field names, unless ``strict``."""
    made = result.materialize()
    if strict or isinstance(made, int | float | str | bool | list):
        return made
    if made is None:
        raise TypeError("'NoneType' object is not iterable")
    return list(made)


def json_safe(x: Any) -> Any:
    """Dates and times as ISO text, inside documents and lists too."""
    match x:
        case datetime() | date():
            return x.isoformat()
        case dict():
            return {k: json_safe(v) for k, v in x.items()}
        case list() | tuple():
            return [json_safe(v) for v in x]
    return x


def canonical(x: Any) -> Any:
    """A form that does not depend on the order of fields; the order in lists stays."""
    match x:
        case dict():
            return tuple((k, canonical(x[k])) for k in sorted(x))
        case list():
            return tuple(map(canonical, x))
    return x


def results_match(a: Any, b: Any) -> bool:
    """Lists as multisets, whatever their order; lists that cannot be sorted in order; others by equality."""
    if not (isinstance(a, list) and isinstance(b, list)):
        return a == b
    left, right = [canonical(x) for x in a], [canonical(x) for x in b]
    try:
        sorted(left), sorted(right)  # noqa: B018  rows of mixed types or with nulls have no order
        return Counter(left) == Counter(right)
    except TypeError:
        return a == b


def is_empty(x: Any) -> bool:
    """Zero, false, and whatever holds nothing."""
    return x == 0 if isinstance(x, int | float) else not x


def frames_match(a: DataFrame, b: DataFrame) -> bool:
    """Whether two DataFrames hold the same rows as often, columns in any order; large results stay distributed."""
    names = sorted(a.columns)
    if names != sorted(b.columns):
        return a.isEmpty() and b.isEmpty()
    tally = lambda df, sign: df.select(*names).withColumn("__n", F.lit(sign))
    return tally(a, 1).unionByName(tally(b, -1)).groupBy(*names).agg(F.sum("__n").alias("__n")).where("__n <> 0").isEmpty()
