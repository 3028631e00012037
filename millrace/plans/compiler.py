"""Query texts to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Value, resolve, without_absent
from ..operators import stages
from ..operators.frame import Frame, scan
from ..sources.catalog import Catalog
from .frontend import parse
from .ir import Call, Chain, ExistsLookup, FlatLookup, Item, QueryError, Stage
from .rewrites import rewrite, used


@dataclass(frozen=True)
class Result:
    """A compiled query. ``kind`` is cursor, values (of distinct), count, document or value."""

    kind: str
    frame: Frame
    #: For a value: what an absent document is called.
    absent: str = ""

    def dataframe(self) -> DataFrame:
        """The rows, lazily. A count has the column count, distinct values the column value."""
        return self.frame.visible()

    def materialize(self) -> Any:
        """The result as plain Python: a list of documents or values, a number, a document or None."""
        if self.kind in ("cursor", "document"):
            rows = [without_absent(r.asDict(recursive=True)) for r in self.frame.documents().collect()]
        else:
            rows = self.dataframe().collect()
        match self.kind:
            case "cursor":
                return rows
            case "values":
                return [r[0] for r in rows]
            case "count":
                return rows[0][0]
            case "document":
                if not rows and self.absent:
                    raise IndexError(self.absent)
                return rows[0] if rows else None
        if not rows:
            raise TypeError(self.absent)
        return rows[0][0]


class Compiler:
    """Compiles queries of one database of a catalog. ``fuse=False`` leaves pipelines as they are written."""

    def __init__(self, catalog: Catalog, database: str, fuse: bool = True):
        self.catalog, self.database, self.fuse = catalog, database, fuse
        self.context = stages.Context(self.collection, self._scalar, self._values, self.pipeline, lambda: catalog.spark.range(1).select(F.lit(1).alias("__one")))

    def compile(self, text: str) -> Result:
        return self.chain(parse(text))

    def collection(self, name: str) -> Frame:
        found = self.catalog.collection(self.database, name)
        if found is None:  # as an empty one, without an error
            return Frame(self.catalog.spark.createDataFrame([], T.StructType([])))
        return scan(found.df, found.order)

    def pipeline(self, frame: Frame, specs: Any) -> Frame:
        """A frame after the stages of a pipeline."""
        if not isinstance(specs, list | tuple) or not all(isinstance(s, dict) and len(s) == 1 for s in specs):
            raise QueryError("a pipeline is a list of stages with one operator each")
        plan = rewrite([Stage(*next(iter(s.items()))) for s in specs], self.fuse)
        for i, stage in enumerate(plan):
            below = None
            if isinstance(stage, FlatLookup) or isinstance(stage, Stage) and stage.op in ("$lookup", "$graphLookup") and isinstance(stage.spec, dict):
                below = used(plan[i + 1 :], stage.spec.get("as", "")) if self.fuse else None
            frame = stages.apply(frame, stage, self.context, below)
        return frame

    def chain(self, chain: Chain) -> Result:
        frame = self.collection(chain.collection)
        first, *rest = chain.steps
        if not isinstance(first, Call):
            raise QueryError("a collection has no items")
        where = first.argument(0, "filter") or {}
        match first.method:
            case "aggregate":
                frame = self.pipeline(frame, first.argument(0, "pipeline", []))
                return self._cursor(frame, rest, plain=False)
            case "count_documents":
                if not first.args and not first.kwargs:
                    raise QueryError("count_documents() missing 1 required positional argument: 'filter'")
                counted = stages.matching(frame, where, self.context).df.agg(F.count(F.lit(1)).alias("count"))
                return self._end(Result("count", Frame(counted)), rest)
            case "distinct":
                frame = stages.matching(frame, first.argument(1, "filter") or {}, self.context)
                return self._end(self._distinct(frame, first.argument(0, "key")), rest)
            case "find_one":
                frame = stages.limit(stages.matching(frame, where, self.context), 1)
                return self._document(self._projected(frame, first.argument(1, "projection")), rest, "")
            case "find":
                frame = stages.matching(frame, where, self.context)
                keywords = dict(first.kwargs)
                calls = [Call(m, (keywords[m],)) for m in ("sort", "skip", "limit") if m in keywords]
                return self._cursor(frame, [*calls, *rest], plain=True, projection=first.argument(1, "projection"))
        raise QueryError(f"a collection has no method {first.method}")

    def _projected(self, frame: Frame, projection: Any) -> Frame:
        if isinstance(projection, list):
            projection = {k: 1 for k in projection}
        return stages.project(frame, projection) if projection else frame

    def _cursor(self, frame: Frame, steps: list, plain: bool, projection: Any = None) -> Result:
        """The cursor's methods: sort, then skip, then limit, in whatever order they are called."""
        wanted: dict[str, Call] = {}
        while steps and isinstance(steps[0], Call) and steps[0].method in ("sort", "skip", "limit"):
            wanted[steps[0].method] = steps[0]
            steps = steps[1:]
        if wanted and not plain:
            raise QueryError(f"a result of aggregate has no method {next(iter(wanted))}")
        if call := wanted.get("sort"):
            keys = call.argument(0, "key_or_list")
            frame = stages.sort(frame, keys if isinstance(keys, list | tuple | dict) else [(keys, call.argument(1, "direction", 1))])
        if steps and isinstance(steps[0], Call) and steps[0].method == "distinct" and plain:
            return self._end(self._distinct(frame, steps[0].argument(0, "key")), steps[1:])
        if call := wanted.get("skip"):
            frame = stages.skip(frame, call.argument(0, "skip"))
        if (call := wanted.get("limit")) and call.argument(0, "limit"):  # a limit of 0 is none
            frame = stages.limit(frame, abs(call.argument(0, "limit")))
        if steps and isinstance(steps[0], Item) and isinstance(steps[0].key, int) and plain:
            frame = stages.limit(stages.skip(frame, steps[0].key) if steps[0].key else frame, 1)
            return self._document(self._projected(frame, projection), steps[1:], "no such item for Cursor instance")
        return self._end(Result("cursor", self._projected(frame, projection)), steps)

    def _document(self, frame: Frame, steps: list, absent: str) -> Result:
        if not steps:
            return Result("document", frame, absent)
        path = [s.key for s in steps if isinstance(s, Item)]
        if len(path) != len(steps) or not all(isinstance(k, str) for k in path):
            raise QueryError("a document has fields alone")
        v = resolve(frame.fields, ".".join(path))
        if v.kind is None:
            raise QueryError(f"no such field: {path[0]!r}")
        return Result("value", frame.of(frame.df.select(v.column.alias("value"))), absent or "'NoneType' object is not subscriptable")

    def _distinct(self, frame: Frame, key: Any) -> Result:
        if not isinstance(key, str):
            raise QueryError("distinct needs the name of a field")
        v = resolve(frame.fields, key)
        if v.kind is None:
            return Result("values", Frame(frame.df.select(F.lit(None).cast("string").alias("value")).filter(F.lit(False))))
        if v.present is not None:
            frame = frame.of(frame.df.filter(v.present))
        column = F.explode(v.column) if isinstance(v.kind, T.ArrayType) else v.column
        return Result("values", Frame(frame.df.select(column.alias("value")).distinct()))

    def _end(self, result: Result, steps: list) -> Result:
        if steps:
            raise QueryError("the result takes no further method or index")
        return result

    def _scalar(self, chain: Chain) -> Value:
        """An inner query that stands for one value: a scalar subquery, which fails where there is none."""
        made = self.chain(chain)
        if made.kind not in ("value", "count"):
            raise QueryError("an inner query must give a single value here")
        df = made.dataframe()
        if made.kind == "value":
            kind, lacking = df.schema[0].dataType, F.raise_error(F.lit(made.absent))
            one = df.limit(1).agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"))
            df = one.select(F.when(F.col("n") == 0, lacking.cast(kind)).otherwise(F.col("value")).alias("value"))
        return Value(df.scalar(), df.schema[0].dataType)

    def _values(self, chain: Chain) -> tuple[DataFrame, T.DataType | None]:
        """An inner query that stands for a list: its values, for a semi or anti join."""
        made = self.chain(chain)
        if made.kind != "values":
            raise QueryError("an inner query must give distinct values here")
        df = made.dataframe()
        return df, df.schema[0].dataType


__all__ = ["Compiler", "ExistsLookup", "Result"]
