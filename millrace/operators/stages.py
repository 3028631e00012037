"""Pipeline stages as DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import Scope, evaluate, truth
from ..functions.values import HAS, Fields, Value, bracket, common_number, document, literal, quoted, resolve
from ..plans.ir import Chain, CountLookup, ExistsLookup, FlatLookup, QueryError, SpreadGroup, Stage
from ..session import stored
from .accumulators import accumulate
from .filters import condition
from .frame import CARRIED, DOWN, HIDDEN, Frame
from .joins import range_join
from .windows import cut_points, window_fields


class Context:
    """What stages need of the compiler: other collections, and values of inner queries."""

    def __init__(self, collection: Callable[[str], Frame], scalar: Callable[[Chain], Value], values: Callable[[Chain], tuple[Any, T.DataType | None]], pipeline: Callable[[Frame, list], Frame], one_row: Callable[[], Any]):
        self.collection, self.scalar, self.values, self.pipeline, self.one_row = collection, scalar, values, pipeline, one_row


def matching(frame: Frame, spec: dict, context: Context) -> Frame:
    """Rows that meet a filter; an inner distinct() as operand of $in becomes a semi join, of $nin an anti join."""
    if not isinstance(spec, dict):
        raise QueryError("a filter must be a document")
    plain: dict = {}
    for key, test in spec.items():
        inner = {op: a for op, a in test.items() if op in ("$in", "$nin") and isinstance(a, Chain)} if isinstance(test, dict) else {}
        if rest := {op: a for op, a in test.items() if op not in inner} if inner else test:
            plain[key] = rest
        elif not inner:
            plain[key] = test
        for op, chain in inner.items():
            frame = _in_query(frame, resolve(frame.fields, key), op, *context.values(chain))
    if plain:
        frame = frame.of(frame.df.filter(condition(plain, frame.fields, context.scalar)))
    return frame


def _in_query(frame: Frame, at: Value, op: str, values: Any, kind: T.DataType | None) -> Frame:
    if isinstance(at.kind, T.ArrayType):
        raise QueryError("$in over an array takes no inner query")
    how = "left_semi" if op == "$in" else "left_anti"
    if kind is None or at.kind is None or at.bracket != Value(F.lit(None), kind).bracket:
        return frame.of(frame.df.filter(F.lit(op == "$nin")))
    return frame.of(frame.df.join(values.toDF("__value"), at.column.eqNullSafe(F.col("__value")), how))


def project(frame: Frame, spec: dict, context: Context | None = None) -> Frame:
    """$project and the projection of find: fields kept, left out, or computed. _id comes first, kept fields in document order."""
    if not isinstance(spec, dict) or not spec:
        raise QueryError("a projection must be a document with fields")
    flag = {k: bool(v) for k, v in spec.items() if isinstance(v, bool | int | float)}
    kept = [k for k, v in flag.items() if v]
    computed = {k: v for k, v in spec.items() if k not in flag}
    fields = frame.fields
    if not kept and not computed and any(k != "_id" for k in flag) or list(flag) == ["_id"] and not flag["_id"] and not computed:
        return _without(frame, [k for k in flag if not flag[k]])
    if any(not v and k != "_id" for k, v in flag.items()):
        raise QueryError("a projection cannot both keep and leave out fields")
    scope = Scope(fields)
    out: dict[str, Value] = {}
    if flag.get("_id", True) and "_id" in fields and "_id" not in computed:
        out["_id"] = resolve(fields, "_id")
    if "_id" in computed:
        out["_id"] = evaluate(computed["_id"], scope)
    for name, value in frame.values().items():
        if name == "_id":
            continue
        inner = [k[len(name) + 1 :] for k in kept if k.startswith(name + ".")]
        if name in kept:
            out[name] = value
        elif inner:
            out[name] = _narrow(value, inner)
    out |= {name: evaluate(x, scope) for name, x in computed.items() if name != "_id"}
    return frame.show(out)


def _narrow(at: Value, paths: list[str]) -> Value:
    """A document, or each of an array, with the fields of some paths alone."""
    if isinstance(at.kind, T.ArrayType):
        kind = _narrow(Value(at.column, at.kind.elementType), paths).kind
        if kind is None:
            return Value(at.column, None)
        return Value(F.transform(at.column, lambda x: _narrow(Value(x, at.kind.elementType), paths).column), T.ArrayType(kind), at.present)
    if not isinstance(at.kind, T.StructType):
        return Value(at.column, None)
    inner = Value(at.column, at.kind, full=True)  # fields of a document that is not null
    own: dict[str, Value] = {}
    for name in at.kind.names:
        if name in paths:
            own[name] = resolve({}, name, inner)
        elif below := [p[len(name) + 1 :] for p in paths if p.startswith(name + ".")]:
            own[name] = _narrow(resolve({}, name, inner), below)
    made = document(own)
    return Value(F.when(at.column.isNotNull(), made.column), made.kind, at.present)


def _without(frame: Frame, names: list[str]) -> Frame:
    df = frame.df.drop(*[n for n in names if n in frame.fields], *[HAS + n for n in names])
    for n in names:
        head, _, rest = n.partition(".")
        if rest and isinstance(frame.fields.get(head), T.StructType):
            df = df.withColumn(head, F.col(quoted(head)).dropFields(rest))
    return frame.of(df)


def add_fields(frame: Frame, spec: dict, context: Context | None = None) -> Frame:
    """$addFields and $set: new or replaced fields. A dotted name goes into a document, which is made where there is none."""
    scope = Scope(frame.fields)
    out = frame.values()
    for name, x in spec.items():
        head, *rest = name.split(".")
        made = evaluate(x, scope)
        if not rest:
            out[head] = made
        elif made.kind is not None:
            out[head] = _put(out.get(head), rest, made)
    return frame.show(out)


def _put(at: Value | None, path: list[str], made: Value) -> Value:
    """A document with a value at a path inside; what is no document gives way to one, and an array gets it in each of its elements."""
    if at is not None and isinstance(at.kind, T.ArrayType):
        element = at.kind.elementType
        kind = _put(Value(F.lit(None), element), path, made).kind
        return Value(F.transform(at.column, lambda x: _put(Value(x, element), path, made).column), T.ArrayType(kind), at.present)
    inner = Value(at.column, at.kind, full=True) if at is not None and isinstance(at.kind, T.StructType) else None
    own = {n: resolve({}, n, inner) for n in at.kind.names if not n.startswith(HAS)} if inner else {}
    own[path[0]] = made if len(path) == 1 else _put(own.get(path[0]), path[1:], made)
    if inner and not at.full:  # the fields of a null are missing in the document that takes its place
        own |= {n: Value(v.column, v.kind, at.column.isNotNull() if v.present is None else v.present & at.column.isNotNull()) for n, v in own.items() if n != path[0]}
    return document(own)


def sort(frame: Frame, spec: Any, context: Context | None = None) -> Frame:
    """$sort: null lowest; ties keep the collection's order. Unknown paths rank nothing."""
    return frame.by(_sort_keys(frame, spec)) if spec else frame


def _directions(spec: Any) -> dict[str, int]:
    items = spec.items() if isinstance(spec, dict) else spec
    out = {}
    for name, way in items:
        if way not in (1, -1):
            raise QueryError("$sort key ordering must be 1 or -1")
        out[name] = way
    return out


def _sort_keys(frame: Frame, spec: Any) -> list[tuple[Column, bool]]:
    out = []
    for name, way in _directions(spec).items():
        v = resolve(frame.fields, name)
        if v.kind is None:
            continue
        c = v.column
        if isinstance(v.kind, T.ArrayType):  # an array ranks by its least or greatest element
            c = F.array_min(c) if way > 0 else F.array_max(c)
        out.append((c, way > 0))
    return out


def limit(frame: Frame, n: int, context: Context | None = None) -> Frame:
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise QueryError("a limit must be a whole number")
    if frame.carried:
        return _placed(frame, lambda place: place <= n)
    return frame.of(_ordered(frame).limit(n), sorted=True)


def limit_stage(frame: Frame, n: int, context: Context | None = None) -> Frame:
    """$limit, which must keep something."""
    if n == 0 and not isinstance(n, bool):
        raise QueryError("the limit must be positive")
    return limit(frame, n)


def skip(frame: Frame, n: int, context: Context | None = None) -> Frame:
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise QueryError("a number to skip must be whole")
    if frame.carried:
        return _placed(frame, lambda place: place > n)
    return frame.of(_ordered(frame).offset(n), sorted=True)


def _placed(frame: Frame, keep: Callable[[Column], Column]) -> Frame:
    """The rows of each tuple of variables whose place in their order is to be kept."""
    order = frame.natural() or [F.lit(1)]
    place = F.row_number().over(Window.partitionBy(*frame.carried).orderBy(*order))
    return frame.of(frame.df.withColumn("__place", place).filter(keep(F.col("__place"))).drop("__place"), sorted=False)


def _ordered(frame: Frame) -> Any:
    return frame.df if frame.sorted or not frame.hidden else frame.df.orderBy(*frame.natural())


def group(frame: Frame, spec: dict, context: Context | None = None) -> Frame:
    """$group. Over no documents a group of all gives no row. $first, $last and $push follow the order of the rows, without a sort where its keys allow it."""
    if not isinstance(spec, dict) or "_id" not in spec:
        raise QueryError("a group specification must include an _id")
    key = evaluate(spec["_id"], Scope(frame.fields))
    column = F.lit(None).cast("string") if key.bracket in ("missing", "null") else key.column
    order = None
    if frame.hidden and any(isinstance(v, dict) and {"$first", "$last", "$push"} & set(v) for v in spec.values()):
        frame, order = _rank(frame, column)
    scope = Scope(frame.fields)
    made = {name: accumulate(a, scope, order) for name, a in spec.items() if name != "_id"}
    grouped = frame.df.groupBy(*frame.carried, column.alias("_id"))
    if not made:
        return Frame(grouped.agg(F.count(F.lit(1)).alias("__n")).drop("__n"), variables=frame.variables)
    df = grouped.agg(*[(v.column.cast("string") if isinstance(v.kind, T.NullType) else v.column).alias(n) for n, v in made.items()])
    return Frame(df, variables=frame.variables)


def _rank(frame: Frame, key: Column) -> tuple[Frame, Column]:
    """A column whose ascending order within a group's ``key`` is the order of the rows.

    Keys that rank downwards are turned round. Arrays inside documents and maps cannot
    be; with such a key rows are numbered by a window.
    """
    parts: list[Column] = []
    for name in frame.hidden:
        turned = _turned(F.col(name), frame.df.schema[name].dataType) if name.startswith(DOWN) else [F.col(name)]
        if turned is None:
            numbered = frame.df.withColumn(f"{HIDDEN}rank", F.row_number().over(Window.partitionBy(*frame.carried, key).orderBy(*frame.natural())))
            return frame.of(numbered), F.col(f"{HIDDEN}rank")
        parts += turned
    return frame, F.struct(*parts)


def _turned(c: Column, kind: T.DataType) -> list[Column] | None:
    """Columns that rank upwards as ``c`` ranks downwards, nulls last; None for types that have none.

    Texts become the complements of their bytes, in hexadecimal digits; the letter
    behind them ranks above all digits, so that a text's beginning comes after it.
    """
    if isinstance(kind, T.NullType):
        return []
    if isinstance(kind, T.StructType):
        inner = [_turned(c.getField(f.name), f.dataType) for f in kind.fields]
        return None if None in inner else [c.isNull(), *(x for parts in inner for x in parts)]
    if isinstance(kind, T.StringType | T.BinaryType):
        return [c.isNull(), F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))]
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return [c.isNull(), ~F.isnan(c), -c]
    if isinstance(kind, T.DecimalType):
        return [c.isNull(), -c]
    if isinstance(kind, T.BooleanType):
        return [c.isNull(), ~c]
    if isinstance(kind, T.IntegralType):
        return [c.isNull(), -c.cast("decimal(20,0)")]  # the least number has no negative of its own type
    if isinstance(kind, T.DateType):
        return [c.isNull(), -F.unix_date(c)]
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return [c.isNull(), -F.unix_micros(c.cast("timestamp")).cast("decimal(20,0)")]
    return None


def unwind(frame: Frame, spec: Any, context: Context | None = None) -> Frame:
    """$unwind: a row for each element in the field's place; a value that is no array is its only element."""
    spec = spec if isinstance(spec, dict) else {"path": spec}
    path = spec.get("path")
    if not isinstance(path, str) or not path.startswith("$"):
        raise QueryError("$unwind needs a path that begins with $")
    name, keep, index = path[1:], bool(spec.get("preserveNullAndEmptyArrays")), spec.get("includeArrayIndex")
    v = resolve(frame.fields, name)
    if v.kind is None:
        return frame if keep else frame.of(frame.df.filter(F.lit(False)))
    head, _, below = name.partition(".")
    if below and not _documents(frame.fields, name):  # a path is not followed into an array
        return frame if keep else frame.of(frame.df.filter(F.lit(False)))
    if not isinstance(v.kind, T.ArrayType):
        frame = frame if keep else frame.of(frame.df.filter(v.column.isNotNull()))
        return frame.show(frame.values() | {index: Value(F.lit(None).cast("long"), T.LongType())}) if index else frame
    explode = (F.posexplode_outer if keep else F.posexplode)(v.column)
    df = frame.df.select("*", explode.alias("__at", "__item"))
    out = frame.values()
    item = Value(F.col("__item"), v.kind.elementType)
    if keep:  # an empty array goes, and with it the field
        there = F.coalesce(F.size(v.column) != 0, F.lit(True))
        item = Value(item.column, item.kind, there if v.present is None else v.present & there)
    if below:  # the field lies in a document, which stays with the element in it
        inner = ".".join(quoted(n) for n in below.split("."))
        at = out[head]
        out[head] = Value(at.column.withField(inner, item.column), _with(at.kind, below.split("."), item.kind), at.present)
    else:
        out[name] = item
    if index:
        out[index] = Value(F.col("__at").cast("long"), T.LongType())
    return frame.show(out, df)


def _with(kind: T.StructType, path: list[str], leaf: T.DataType) -> T.StructType:
    """The type of a document whose field at ``path`` is of another type."""
    first, *rest = path
    return T.StructType([T.StructField(f.name, (_with(f.dataType, rest, leaf) if rest else leaf) if f.name == first else f.dataType) for f in kind])


def _documents(fields: dict[str, T.DataType], path: str) -> bool:
    """Whether all of a path but its end are documents."""
    names = path.split(".")
    return all(isinstance(resolve(fields, ".".join(names[:i])).kind, T.StructType) for i in range(1, len(names)))


#: Brackets of values that are not there.
_EMPTY = ("missing", "null")


def _meeting(local: Value, other: Value) -> tuple[Column, Column]:
    """Two columns that are equal, null to null, where the values match. Null matches null and missing; different types never match."""
    if local.bracket == other.bracket and local.bracket not in _EMPTY:
        return local.column, other.column
    mark = lambda v: F.when(F.lit(True) if v.bracket in _EMPTY else v.column.isNull(), F.lit(1))
    return F.coalesce(mark(local), F.lit(2)), F.coalesce(mark(other), F.lit(3))


def _sides(frame: Frame, spec: dict, context: Context, exists: bool = False) -> tuple[Fields, Column, Column, Any]:
    """The foreign fields, the local and the foreign key, which are comparable without coercion, and the foreign rows."""
    if "startWith" in spec:
        return _reached(frame, spec, context)
    needed = {"from", "as"} | (set() if "pipeline" in spec and not {"localField", "foreignField"} & set(spec) else {"localField", "foreignField"})
    if missing := needed - set(spec):
        raise QueryError(f"$lookup needs {', '.join(sorted(missing))}")
    foreign = context.collection(spec["from"])
    if "pipeline" in spec:
        return _correlated(frame, foreign, spec, context, exists)
    local, other = resolve(frame.fields, spec["localField"]), resolve(foreign.fields, spec["foreignField"])
    df = foreign.documents()
    whole = other
    if isinstance(other.kind, T.ArrayType):  # a foreign array matches by any element
        df = df.withColumn("__key", F.explode(F.coalesce(F.array_distinct(other.column), F.array(F.lit(None).cast(other.kind.elementType)))))
        other = Value(F.col("__key"), other.kind.elementType)
    if isinstance(local.kind, T.ArrayType):
        return foreign.fields, local.column, F.col("__array"), _by_elements(frame, local, whole, other, df)
    return foreign.fields, *_meeting(local, other), df


def _by_elements(frame: Frame, local: Value, whole: Value, other: Value, df: Any) -> Any:
    """The foreign rows that an array's elements match, with the array as __array, each once for each different array.

    Which rows match depends on the array alone, so equal arrays are joined
    once, and no row needs a number to find its matches again. A null array
    matches as null does, an empty one nothing. A foreign array that meets
    several elements counts by the first of them.
    """
    element = local.kind.elementType
    arrays = frame.df.select(local.column.alias("__array")).distinct()
    each = arrays.withColumn("__mine", F.explode(F.coalesce(F.array_distinct("__array"), F.array(F.lit(None).cast(element)))))
    mine, theirs = _meeting(Value(F.col("__mine"), element), other)
    found = each.join(df.withColumn("__theirs", theirs), mine.eqNullSafe(F.col("__theirs")))
    if isinstance(whole.kind, T.ArrayType) and bracket(element) == other.bracket:
        both = T.ArrayType(common_number(element, other.kind) if other.bracket == "number" else element)
        meet = F.array_intersect(F.coalesce(F.array_distinct(whole.column), F.array(F.lit(None).cast(other.kind))).cast(both), F.coalesce(F.col("__array"), F.array(F.lit(None).cast(element))).cast(both))
        found = found.filter(F.get(meet, F.lit(0)).eqNullSafe(F.col("__key").cast(both.elementType)))
    return found.drop("__mine", "__theirs")


def _conjuncts(spec: Any) -> list:
    return [c for part in spec["$and"] for c in _conjuncts(part)] if isinstance(spec, dict) and list(spec) == ["$and"] and isinstance(spec["$and"], list) else [spec]


def _reads(spec: Any) -> tuple[bool, bool]:
    """Whether an expression reads fields, and whether variables of the lookup (whose names are not system ones)."""
    match spec:
        case str() if spec.startswith("$$"):
            return spec[2:].partition(".")[0] in ("ROOT", "CURRENT"), spec[2:].partition(".")[0] not in ("ROOT", "CURRENT")
        case str() if spec.startswith("$"):
            return True, False
        case dict() if "$literal" in spec:
            return False, False
        case dict() | list() | tuple():
            each = [_reads(x) for x in (spec.values() if isinstance(spec, dict) else spec)]
            return any(f for f, _ in each), any(v for _, v in each)
    return False, False


def _correlated(frame: Frame, foreign: Frame, spec: dict, context: Context, exists: bool = False) -> tuple[Fields, Column, Column, Any]:
    """A lookup with a pipeline: its result for each different tuple of variables, with the tuple as __tuple.

    The pipeline runs once over all tuples. Of its first filters, equalities of
    a field and a variable join foreign rows to the tuples, and others of
    variables are conditions of that join; those of fields alone filter before
    it. What follows is done for each tuple: groups and counts by it, limits by
    the place in its order. Where it is only asked whether a tuple ``exists``
    in the result, rows that differ in one bounded field are one row.
    """
    scope = Scope(frame.fields)
    values = {n: evaluate(x, scope) for n, x in (spec.get("let") or {}).items()}
    outer = {n: Value(F.col(c), frame.df.schema[c].dataType) for n, c in frame.variables.items() if n not in values}
    values = outer | values
    if "localField" in spec:
        values["__local"] = resolve(frame.fields, spec["localField"])
    depth = 1 + max((int(c[len(CARRIED) :].partition("_")[0]) for c in frame.carried), default=0)
    kind_of = lambda v: T.StringType() if v.bracket in _EMPTY else v.kind
    names = {n: f"{CARRIED}{depth}_{i}" for i, n in enumerate(values)}
    made = {names[n]: Value(v.column.cast("string") if v.bracket in _EMPTY else v.column, kind_of(v)) for n, v in values.items()}
    tuples = frame.df.select(*[v.column.alias(c) for c, v in made.items()]).distinct() if made else None
    # what a variable is, inside; a value that is missing or null for all stays so
    inside = {n: Value(F.col(names[n]), v.kind if v.bracket not in _EMPTY else T.NullType()) for n, v in values.items()}

    rest = list(spec["pipeline"])
    keys, conditions = [], []
    plain = foreign
    if "localField" in spec:
        local, other = inside["__local"], resolve(foreign.fields, spec["foreignField"])
        if isinstance(local.kind, T.ArrayType) or isinstance(other.kind, T.ArrayType):
            raise QueryError("$lookup with a pipeline takes no arrays as localField or foreignField")
        a, b = _meeting(local, other)
        keys.append((a, b))
    while rest and isinstance(rest[0], dict) and list(rest[0]) == ["$match"]:
        test = dict(rest.pop(0)["$match"])
        expression = test.pop("$expr", None)
        if test:
            plain = matching(plain, test, context)
        for c in _conjuncts(expression) if expression is not None else []:
            if not _reads(c)[1]:
                plain = matching(plain, {"$expr": c}, context)
                continue
            pair = _equality(c, plain.fields, inside)
            keys.append(pair) if pair else conditions.append(c)
    if tuples is None:
        joined = plain.df
    else:
        variables = {n: v for n, v in inside.items()}
        seen = Scope(Fields.of(plain.df.schema, (HIDDEN, CARRIED), variables))
        if exists and keys and not rest and (extreme := _extreme(conditions, plain.fields, inside)):  # whether any row meets the conditions, the greatest or least value tells
            at, most = extreme
            groups = plain.df.select(*[b.alias(f"__key{i}") for i, (_, b) in enumerate(keys)], evaluate(f"${at}", seen).column.alias("__at"))
            utmost = F.max("__at") if most else F.when(F.count("__at") == F.count(F.lit(1)), F.min("__at"))  # null is less than any value
            ends = groups.groupBy(*[f"__key{i}" for i in range(len(keys))]).agg(utmost.alias(at))
            met = tuples.join(ends, reduce(lambda a, b: a & b, [a.eqNullSafe(F.col(f"__key{i}")) for i, (a, _) in enumerate(keys)] + [truth(evaluate(c, seen)) for c in conditions]))
            return plain.fields, F.struct(*[v.column.alias(c) for c, v in made.items()]), F.col("__tuple"), met.select(F.struct(*made).alias("__tuple"))
        right = plain.df.select("*", *[b.alias(f"__key{i}") for i, (_, b) in enumerate(keys)])
        on = [a.eqNullSafe(F.col(f"__key{i}")) for i, (a, _) in enumerate(keys)] + [truth(evaluate(c, seen)) for c in conditions]
        ranged = None if keys else _ranged(tuples, right, conditions, plain.fields, inside, seen)
        joined = ranged if ranged is not None else tuples.join(right, on, "inner") if on else tuples.crossJoin(right)
        joined = joined.drop(*[f"__key{i}" for i in range(len(keys))])
    begun = Frame(joined, plain.sorted, plain.ranked, {n: c for n, c in names.items() if n != "__local"})
    ended = context.pipeline(begun, rest)
    columns = [F.col(quoted(n)) for n in ended.df.columns if not n.startswith((HIDDEN, CARRIED))]
    if not made:
        return ended.fields, F.lit(1), F.lit(1), ended.df.select(*columns)
    return ended.fields, F.struct(*[v.column.alias(c) for c, v in made.items()]), F.col("__tuple"), ended.df.select(*columns, F.struct(*made).alias("__tuple"))


def _extreme(conditions: list, fields: Fields, inside: dict[str, Value]) -> tuple[str, bool] | None:
    """The column that all conditions bound by variables from one side, and whether it is from below; None if they are others."""
    found = set()
    for c in conditions:
        if not (isinstance(c, dict) and len(c) == 1 and (op := next(iter(c))) in _TURNED and isinstance(c[op], list) and len(c[op]) == 2):
            return None
        a, b = c[op]
        if _reads(a) == (False, True):
            a, b, op = b, a, _TURNED[op]
        if not (isinstance(a, str) and a[1:] in fields and a[1:] not in fields.ragged and _reads(a) == (True, False) and _reads(b) == (False, True)):
            return None
        at, value = evaluate(a, Scope(fields, {})), evaluate(b, Scope({}, inside))
        if at.bracket != value.bracket or at.bracket not in ("number", "time", "string"):
            return None
        found.add((a[1:], op.startswith("$gt")))
    return found.pop() if len(found) == 1 else None


#: Comparisons of a field and a variable: of a field first, and turned round.
_TURNED = {"$lt": "$gt", "$lte": "$gte", "$gt": "$lt", "$gte": "$lte"}


def _ranged(tuples: Any, right: Any, conditions: list, fields: Fields, inside: dict[str, Value], seen: Scope) -> Any:
    """A join by inequalities of one field and variables, as a point in a span; None if there are none.

    Foreign rows without the field, which expressions take for less than any
    value, are few or all alike; they meet the tuples by the conditions alone.
    """
    bounds: dict[str, list[tuple[str, Value]]] = {}
    for c in conditions:
        if not (isinstance(c, dict) and len(c) == 1 and (op := next(iter(c))) in _TURNED and isinstance(c[op], list) and len(c[op]) == 2):
            continue
        a, b = c[op]
        if _reads(a) == (False, True):
            a, b, op = b, a, _TURNED[op]
        if isinstance(a, str) and _reads(a) == (True, False) and _reads(b) == (False, True):
            at, value = evaluate(a, Scope(fields, {})), evaluate(b, Scope({}, inside))
            if at.bracket == value.bracket and at.bracket in ("number", "time"):
                bounds.setdefault(a, []).append((op, value))
    if not bounds:
        return None
    path, tests = max(bounds.items(), key=lambda x: len({op[:3] for op, _ in x[1]}))
    at = evaluate(path, Scope(fields, {})).column
    endless = {-1: F.lit(float("-inf")), 1: F.lit(float("inf"))}
    number = lambda v: v.column.cast("double") if v.bracket == "number" else F.unix_micros(v.column.cast("timestamp")).cast("double")
    lows, highs = ([number(v) for op, v in tests if op.startswith(way)] for way in ("$gt", "$lt"))
    low = F.greatest(*lows, endless[-1]) if lows else endless[-1]  # a null bound from below holds for all
    high = F.when(reduce(lambda a, b: a | b, [c.isNull() for c in highs]), F.lit(None)).otherwise(F.least(*highs, endless[1])) if highs else endless[1]  # nothing is less than null
    whole = reduce(lambda a, b: a & b, [truth(evaluate(c, seen)) for c in conditions])
    point = number(Value(at, evaluate(path, Scope(fields, {})).kind))
    there = range_join(tuples, right.filter(at.isNotNull()), (low, high), (point, point), whole)
    if not right.select(at.alias("x")).schema["x"].nullable:
        return there
    return there.unionByName(tuples.join(right.filter(at.isNull()), whole, "inner"))


def _equality(c: Any, fields: Fields, inside: dict[str, Value]) -> tuple[Column, Column] | None:
    """The two columns that an equality of a variable and a field compares, or None if it is something else."""
    if not (isinstance(c, dict) and list(c) == ["$eq"] and isinstance(c["$eq"], list) and len(c["$eq"]) == 2):
        return None
    a, b = c["$eq"]
    if _reads(a) == (True, False):
        a, b = b, a
    if _reads(a) != (False, True) or _reads(b) != (True, False):
        return None
    left, right = evaluate(a, Scope({}, inside)), evaluate(b, Scope(fields, {}))
    return (left.column, right.column) if left.bracket == right.bracket and left.bracket not in _EMPTY else None


def _single(v: Value, kind: T.DataType) -> Column:
    """The values that a start or a link has: a value itself, or an array's elements, each once."""
    return F.explode(F.array_distinct(v.column.cast(T.ArrayType(kind)))) if isinstance(v.kind, T.ArrayType) else v.column.cast(kind)


def _walked(frame: Frame, spec: dict, context: Context) -> tuple[Frame, Value, Value, T.DataType | None, Any, Any]:
    """What a $graphLookup walks on: the documents, start and end of their links, the type of values, starts with their values, links.

    Without a type nothing is reached; without links nothing is reached from documents. Links that nothing can lead to are left out.
    """
    foreign = context.collection(spec["from"])
    if spec.get("restrictSearchWithMatch"):
        foreign = matching(foreign, spec["restrictSearchWithMatch"], context)
    start, to, onward = evaluate(spec["startWith"], Scope(frame.fields)), resolve(foreign.fields, spec["connectToField"]), resolve(foreign.fields, spec["connectFromField"])
    element = lambda v: v.kind.elementType if isinstance(v.kind, T.ArrayType) else v.kind
    kinds = {bracket(element(v)) for v in (start, to)}
    if len(kinds) > 1 or kinds & set(_EMPTY):
        return foreign, start, to, None, None, None
    kind = common_number(element(start), element(to)) if kinds == {"number"} else element(to)
    starts = frame.df.select(start.column.alias("__start")).distinct()
    values = starts.select("__start", _single(Value(F.col("__start"), start.kind), kind).alias("__value")).distinct()
    links = None
    if bracket(element(onward)) in kinds and spec.get("maxDepth") != 0:
        links = foreign.df.select(_single(to, kind).alias("__value"), onward.column.alias("__onward"))
        links = stored(links.select("__value", _single(Value(F.col("__onward"), onward.kind), kind).alias("__next")).distinct())
        led = values.select(F.col("__value").alias("__led")).unionByName(links.select(F.col("__next").alias("__led"))).distinct()
        links = stored(links.join(led, F.col("__value").eqNullSafe(F.col("__led")), "left_semi"))
    return foreign, start, to, kind, values, links


#: Values whose reach is found once for all starts that reach them.
HUBS = 32


def _reached_counts(frame: Frame, spec: dict, context: Context, counts: Callable[[Fields], list[Column]]) -> tuple[Column, Any] | None:
    """The local key, and for each start (__key) sums of counts over the documents reached; None where they depend on more than values.

    What a start reaches is not listed. Some values, evenly chosen by hash, are
    hubs; rings forward and backward tell what each reaches and what reaches it.
    A start that reaches hubs has all that the hub of the widest reach reaches,
    as one sum, and is walked on only outside of that: a walk that enters it
    stays in it. A start that reaches no hub meets no value that reaches one. So
    the part of a graph that reaches most of itself, of which the number of pairs
    grows with the square, is walked by the hubs alone.
    """
    if "depthField" in spec or spec.get("maxDepth") is not None or {"from", "startWith", "connectFromField", "connectToField", "as"} - set(spec):
        return None
    foreign, start, to, kind, values, links = _walked(frame, spec, context)
    if kind is None or links is None or isinstance(to.kind, T.ArrayType):
        return None
    per = foreign.documents().groupBy(to.column.cast(kind).alias("__to")).agg(*counts(foreign.fields))
    names = per.columns[1:]
    per = stored(per)
    values = stored(values)
    chosen = values.select("__value").unionByName(links.select(F.col("__next").alias("__value"))).distinct().join(links.select(F.col("__value").alias("__from")), F.col("__value").eqNullSafe(F.col("__from")), "left_semi")
    hubs = stored(chosen.orderBy(F.xxhash64("__value"), "__value").limit(HUBS).select(F.monotonically_increasing_id().alias("__start"), "__value"))
    turned = links.select(F.col("__next").alias("__value"), F.col("__value").alias("__next"))
    reach, reaching = _rings(hubs, links), _rings(hubs, turned)
    wide = reach.groupBy(F.col("__start").alias("__hub")).agg(F.count(F.lit(1)).alias("__wide"))
    from_hub = lambda df: df.select(F.col("__start").alias("__hub"), F.col("__value").alias("__in"))
    best = values.join(from_hub(reaching), F.col("__value").eqNullSafe(F.col("__in"))).join(F.broadcast(wide), "__hub")
    best = best.groupBy(F.col("__start").alias("__who")).agg(F.max(F.struct("__wide", "__hub"))["__hub"].alias("__hub"))
    begun = stored(values.join(best, F.col("__start").eqNullSafe(F.col("__who")), "left").drop("__who"))
    rest = _rings(begun, links, from_hub(reach))
    sums = [F.sum(n).alias(n) for n in names]
    alone = rest.select(F.col("__start").alias("__key"), "__value").join(per, F.col("__value").eqNullSafe(F.col("__to"))).select("__key", *names)
    total = reach.join(per, F.col("__value").eqNullSafe(F.col("__to"))).groupBy(F.col("__start").alias("__hub")).agg(*sums)
    shared = begun.select(F.col("__start").alias("__key"), "__hub").distinct().join(F.broadcast(total), "__hub").select("__key", *names)
    return start.column, alone.unionByName(shared).groupBy("__key").agg(*sums)


def _rings(values: Any, links: Any, known: Any = None) -> Any:
    """__start and each __value that is reached from it, once, ring by ring; ``values`` that have a __hub stay out of what ``known`` (__hub, __in) lists for it."""
    more = [c for c in values.columns if c == "__hub"]
    outside = lambda ring: ring.join(known, (ring["__hub"] == known["__hub"]) & F.col("__value").eqNullSafe(F.col("__in")), "left_anti") if more else ring
    rings = [stored(outside(values))]
    while True:
        found = rings[-1].join(links.withColumnRenamed("__value", "__from"), F.col("__value").eqNullSafe(F.col("__from"))).select("__start", F.col("__next").alias("__value"), *more).distinct()
        before = reduce(lambda a, b: a.unionByName(b), rings).select(F.col("__start").alias("__old"), F.col("__value").alias("__seen"))
        ring = stored(outside(found).join(before, F.col("__start").eqNullSafe(F.col("__old")) & F.col("__value").eqNullSafe(F.col("__seen")), "left_anti"))
        if ring.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), rings)
        rings.append(ring)


def _reached(frame: Frame, spec: dict, context: Context) -> tuple[Fields, Column, Column, Any]:
    """$graphLookup: for each different start, as __start, the documents that are reached from it, each once.

    A start's visited values grow ring by ring, until no ring brings a new one:
    what a ring finds is joined to the links of the collection, and what was
    visited before is taken out. Starts and values are dealt by value; a value
    with many links is split as a skewed key of a join. Each ring is stored, so
    the plan does not grow with depth.
    """
    if missing := {"from", "startWith", "connectFromField", "connectToField", "as"} - set(spec):
        raise QueryError(f"$graphLookup needs {', '.join(sorted(missing))}")
    most = spec.get("maxDepth")
    if most is not None and (not isinstance(most, int) or isinstance(most, bool) or most < 0):
        raise QueryError("maxDepth must be a whole number")
    foreign, start, to, kind, values, links = _walked(frame, spec, context)
    df = foreign.documents()
    if kind is None:  # nothing of one type reaches another
        df = df.withColumns({"__start": F.lit(1), "__depth": F.lit(0).cast("long")}).filter(F.lit(False))
        return _with_depth(foreign.fields, spec, df, F.lit(2), F.col("__start"))
    keep = lambda ring: stored(ring.select("__start", "__value", "__depth"))
    ring = keep(values.withColumn("__depth", F.lit(0).cast("long")))
    rings, depth = [ring], 0
    while links is not None and (most is None or depth < most):
        depth += 1
        found = ring.join(links.withColumnRenamed("__value", "__from"), F.col("__value").eqNullSafe(F.col("__from"))).select("__start", F.col("__next").alias("__value")).distinct()
        before = reduce(lambda a, b: a.unionByName(b), rings).select(F.col("__start").alias("__old"), F.col("__value").alias("__known"))
        new = found.join(before, F.col("__start").eqNullSafe(F.col("__old")) & F.col("__value").eqNullSafe(F.col("__known")), "left_anti")
        ring = keep(new.withColumn("__depth", F.lit(depth).cast("long")))
        if ring.isEmpty():
            break
        rings.append(ring)
    visited = reduce(lambda a, b: a.unionByName(b), rings)
    if isinstance(to.kind, T.ArrayType):  # a document is reached by the first of its values that is
        at = F.struct(*[F.col(n) for n in foreign.hidden]) if foreign.hidden else F.struct(*[F.col(quoted(n)) for n in foreign.fields])
        keyed = foreign.df.withColumn("__at", at)
        least = keyed.select("__at", _single(to, kind).alias("__to")).join(visited, F.col("__to").eqNullSafe(F.col("__value"))).groupBy("__start", "__at").agg(F.min("__depth").alias("__depth"))
        found = least.withColumnRenamed("__at", "__met").join(keyed, F.col("__met").eqNullSafe(F.col("__at"))).drop("__met", "__at", *foreign.hidden)
    else:
        found = visited.join(df.withColumn("__to", to.column.cast(kind)), F.col("__value").eqNullSafe(F.col("__to"))).drop("__value", "__to")
    return _with_depth(foreign.fields, spec, found, start.column, F.col("__start"))


def _with_depth(fields: Fields, spec: dict, df: Any, local: Column, other: Column) -> tuple[Fields, Column, Column, Any]:
    """What $graphLookup gives to a join, with the depth as a field where one is asked for."""
    name = spec.get("depthField")
    if name is None:
        return fields, local, other, df.drop("__depth")
    return Fields({**fields, name: T.LongType()}, fields.ragged, fields.full), local, other, df.withColumnRenamed("__depth", name)


def _needed(fields: Fields, below: set[str] | None) -> list[str]:
    if below is None:
        return list(fields)
    return [n for n in fields if any(p == n or p.startswith(n + ".") for p in below)] or list(fields)[:1]


def _element(fields: Fields, names: list[str]) -> Column:
    """A foreign document of some fields, with what tells which of them it has."""
    return F.struct(*[F.col(quoted(n)) for n in names], *[F.col(quoted(HAS + n)) for n in names if n in fields.ragged])


def lookup(frame: Frame, spec: dict, context: Context, below: set[str] | None = None) -> Frame:
    """$lookup: the matching foreign documents as an array, of the fields that are read later.

    Null and missing keys match each other. Keys of different types never do.
    """
    fields, local, other, df = _sides(frame, spec, context)
    names = _needed(fields, below)
    element = _element(fields, names) if names else F.struct(F.lit(None).cast("string").alias("_"))
    right = df.groupBy(other.alias("__key")).agg(F.collect_list(element).alias("__found"))
    joined = frame.df.join(right, local.eqNullSafe(F.col("__key")), "left")
    kind = right.schema["__found"].dataType
    made = Value(F.coalesce("__found", F.array().cast(kind.simpleString())), kind)
    return frame.show(frame.values() | {spec["as"]: made}, joined, sorted=False)


def flat_lookup(frame: Frame, node: FlatLookup, context: Context, below: set[str] | None = None) -> Frame:
    """A lookup that is unwound: an inner (or left) join, a row for each match."""
    spec = node.spec
    fields, local, other, df = _sides(frame, spec, context)
    if not fields:
        return unwind(lookup(frame, spec, context, below), {"path": f"${spec['as']}", "preserveNullAndEmptyArrays": node.outer})
    right = df.select(other.alias("__key"), _element(fields, _needed(fields, below)).alias("__one"))
    joined = frame.df.join(right, local.eqNullSafe(F.col("__key")), "left" if node.outer else "inner")
    one = Value(F.col("__one"), right.schema["__one"].dataType, F.col("__one").isNotNull() if node.outer else None, not node.outer)
    return frame.show(frame.values() | {spec["as"]: one}, joined, sorted=False)


def exists_lookup(frame: Frame, node: ExistsLookup, context: Context) -> Frame:
    """A lookup that is only asked whether it found something."""
    _, local, other, df = _sides(frame, node.spec, context, exists=True)
    right = df.select(other.alias("__key"))
    kept = frame.df.join(right, local.eqNullSafe(F.col("__key")), "left_semi" if node.found else "left_anti")
    return frame.of(kept.drop(node.spec["as"]) if node.spec["as"] in frame.fields else kept, sorted=False)


def count_lookup(frame: Frame, node: CountLookup, context: Context) -> Frame:
    """A lookup whose matches are only counted: a join with one row of counts for each key."""
    meets = {"all": lambda c, fields: F.lit(True), "expression": lambda c, fields: truth(evaluate(c, Scope(fields))), "filter": lambda c, fields: condition(c, fields, context.scalar)}
    counts = lambda fields: [F.count_if(F.coalesce(meets[how](cond, fields), F.lit(False))).alias(n) for n, how, cond in node.counts]
    if "startWith" in node.spec and (found := _reached_counts(frame, node.spec, context, counts)):
        local, right = found
    else:
        fields, local, other, df = _sides(frame, node.spec, context)
        right = df.groupBy(other.alias("__key")).agg(*counts(fields))
    joined = frame.df.join(right, local.eqNullSafe(F.col("__key")), "left")
    made = {n: Value(F.coalesce(F.col(n), F.lit(0)), T.LongType(), full=True) for n, _, _ in node.counts}
    return frame.show({n: v for n, v in frame.values().items() if n != node.spec["as"]} | made, joined, sorted=False)


def spread_group(frame: Frame, node: SpreadGroup, context: Context) -> Frame:
    """$group of all with a list that is unwound: the documents beside the one row of totals, in the order of the list."""
    v = evaluate(node.spec[node.name]["$push"], Scope(frame.fields))
    if v.kind is None or frame.carried:
        return unwind(group(frame, node.spec), f"${node.name}")
    totals = group(frame, {k: a for k, a in node.spec.items() if k != node.name}).df
    rows = frame.df if v.present is None else frame.df.filter(v.present)  # what is missing is not listed
    both = rows.select(v.column.alias("__item"), *frame.hidden).crossJoin(F.broadcast(totals))  # at most one row
    columns = [F.col("__item").alias(n) if n == node.name else F.col(quoted(n)) for n in ["_id", *(k for k in node.spec if k != "_id")]]
    return frame.of(both.select(*columns, *frame.hidden), sorted=False)


def count(frame: Frame, name: str, context: Context | None = None) -> Frame:
    """$count: one row, or none over no documents."""
    if frame.carried:
        return Frame(frame.df.groupBy(*frame.carried).agg(F.count(F.lit(1)).alias(name)), variables=frame.variables)
    df = frame.df.agg(F.count(F.lit(1)).alias(name)).filter(F.col(quoted(name)) > 0)
    return Frame(df)


def replace_root(frame: Frame, spec: Any, context: Context | None = None) -> Frame:
    """$replaceRoot and $replaceWith: a document of the document takes its place."""
    v = evaluate(spec["newRoot"] if isinstance(spec, dict) and "newRoot" in spec else spec, Scope(frame.fields))
    if not isinstance(v.kind, T.StructType):
        raise QueryError("the new root must be a document")
    df = frame.df.withColumn("__root", v.column)
    return frame.of(df.select(*[F.col("__root").getField(n).alias(n) for n in v.kind.names], *frame.carried, *frame.hidden))


def union_with(frame: Frame, spec: Any, context: Context) -> Frame:
    """$unionWith: the documents of another collection, or of a pipeline over it, as well. Each keeps to the fields of its own."""
    if frame.carried:
        raise QueryError("$unionWith inside the pipeline of a $lookup is not supported")
    name = spec if isinstance(spec, str) else spec["coll"]
    other = context.collection(name)
    if isinstance(spec, dict) and spec.get("pipeline"):
        other = context.pipeline(other, spec["pipeline"])
    sides = []
    ragged = {n for n in [*frame.fields, *other.fields] if n in frame.fields.ragged | other.fields.ragged or (n in frame.fields) != (n in other.fields)}
    for side in (frame, other):
        df, own = side.documents(), side.fields
        sides.append(df.withColumns({HAS + n: F.lit(n in own) for n in ragged if n not in own.ragged}) if ragged else df)
    return Frame(sides[0].unionByName(sides[1], allowMissingColumns=True))


def unset(frame: Frame, spec: Any, context: Context | None = None) -> Frame:
    return _without(frame, [spec] if isinstance(spec, str) else list(spec))


def facet(frame: Frame, spec: dict, context: Context) -> Frame:
    """$facet: one document with the results of several pipelines over the same documents.

    Branches that filter and then group or count are one aggregate: every
    document goes once to each branch whose filter it meets. Where others need
    the documents themselves, those are stored once for all branches.
    """
    if not isinstance(spec, dict) or not spec or not all(isinstance(p, list) for p in spec.values()):
        raise QueryError("$facet needs pipelines by name")
    if odd := next((op for p in spec.values() for s in p for op in s if op == "$facet"), None):
        raise QueryError(f"{odd} is not allowed inside a $facet")
    if frame.carried:
        raise QueryError("$facet inside the pipeline of a $lookup is not supported")
    grouped = {name: split for name, p in spec.items() if (split := _grouping(p)) is not None}
    if len(grouped) < len(spec):
        frame = replace(frame, df=stored(frame.df), sorted=False)
    made = dict(_grouped_at_once(frame, grouped, context)) if grouped else {}
    arrays = []
    for name, pipeline in spec.items():
        ended = context.pipeline(*((made[name], grouped[name][2]) if name in made else (frame, pipeline)))
        if not ended.fields:
            kind = T.ArrayType(T.StructType([T.StructField("_", T.StringType())]))
            arrays.append((name, kind, None))
            continue
        listed = group(ended, {"_id": None, name: {"$push": "$$ROOT"}}).df.select(F.col(quoted(name)).alias("__list"))
        arrays.append((name, listed.schema[0].dataType, listed))
    df = context.one_row()
    for i, (_, kind, listed) in enumerate(arrays):
        empty = F.array().cast(kind.simpleString())
        if listed is None:
            df = df.withColumn(f"__f{i}", empty)
        else:  # one row at most
            df = df.join(F.broadcast(listed.withColumnRenamed("__list", f"__f{i}")), F.lit(True), "left").withColumn(f"__f{i}", F.coalesce(f"__f{i}", empty))
    return Frame(df.select(*[F.col(f"__f{i}").alias(name) for i, (name, _, _) in enumerate(arrays)]))


#: Accumulators that no order of documents changes.
_UNORDERED = {"$sum", "$avg", "$min", "$max", "$count", "$addToSet", "$stdDevPop", "$stdDevSamp"}


def _grouping(pipeline: list) -> tuple[list, dict, list] | None:
    """A pipeline as filters, a group without order, and what follows; None if it is none."""
    filters: list = []
    for i, stage in enumerate(pipeline):
        ((op, spec),) = stage.items()
        if op == "$match" and not any(isinstance(a, Chain) for t in spec.values() if isinstance(t, dict) for a in t.values()):
            filters.append(spec)
        elif op == "$count" and isinstance(spec, str):
            return filters, {"_id": None, spec: {"$sum": 1}}, [{"$project": {"_id": 0}}, *pipeline[i + 1 :]]
        elif op == "$group" and isinstance(spec, dict) and "_id" in spec and all(isinstance(a, dict) and set(a) <= _UNORDERED for n, a in spec.items() if n != "_id"):
            return filters, spec, pipeline[i + 1 :]
        else:
            return None
    return None


def _grouped_at_once(frame: Frame, branches: dict[str, tuple[list, dict, list]], context: Context) -> list[tuple[str, Frame]]:
    """The groups of several branches in one aggregate over one scan; its few rows are stored for the branches."""
    fields = frame.fields
    scope = Scope(fields)
    tests, keys, made = [], [], []
    for i, (filters, spec, _) in enumerate(branches.values()):
        test = reduce(lambda a, b: a & b, [condition(f, fields, context.scalar) for f in filters], F.lit(True))
        tests.append(F.when(test, F.lit(i)))
        key = evaluate(spec["_id"], scope)
        keys.append(F.lit(None).cast("string") if key.bracket in _EMPTY else key.column)
        made.append({n: accumulate(a, scope, None) for n, a in spec.items() if n != "_id"})
    spread = frame.df.withColumn("__branch", F.explode(F.array_compact(F.array(*tests))))
    by = [F.when(F.col("__branch") == i, k).alias(f"__k{i}") for i, k in enumerate(keys)]
    columns = [(v.column.cast("string") if isinstance(v.kind, T.NullType) else v.column).alias(f"__a{i}_{n}") for i, own in enumerate(made) for n, v in own.items()]
    table = stored(spread.groupBy("__branch", *by).agg(F.count(F.lit(1)).alias("__n"), *columns))
    out = []
    for i, (name, own) in enumerate(zip(branches, made, strict=True)):
        shown = [F.col(f"__k{i}").alias("_id"), *[F.col(quoted(f"__a{i}_{n}")).alias(n) for n in own]]
        out.append((name, Frame(table.where(F.col("__branch") == i).select(*shown))))
    return out


def bucket(frame: Frame, spec: dict, context: Context | None = None) -> Frame:
    """$bucket: groups between given boundaries; other values go to ``default``, and are an error without it."""
    bounds, default = spec.get("boundaries"), spec.get("default")
    if not isinstance(bounds, list) or len(bounds) < 2 or sorted(bounds) != bounds or len(set(bounds)) != len(bounds):
        raise QueryError("$bucket needs ascending boundaries")
    at = evaluate(spec["groupBy"], Scope(frame.fields))
    if at.bracket != literal(bounds[0]).bracket:
        raise QueryError("the boundaries are of another type than the values")
    outside = F.raise_error(F.lit("$bucket: a value is outside of the boundaries")).cast(literal(bounds[0]).kind) if "default" not in spec else F.lit(default)
    if "default" in spec and literal(default).bracket != at.bracket:
        raise QueryError("a default of another type than the boundaries has no column type")
    key = F.lit(None)
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        key = F.when((at.column >= F.lit(low)) & (at.column < F.lit(high)), F.lit(low)).otherwise(key)
    inside = F.coalesce((at.column >= F.lit(bounds[0])) & (at.column < F.lit(bounds[-1])), F.lit(False))
    placed = frame.of(frame.df.withColumn("__bucket", F.when(inside, key).otherwise(outside)))
    return sort(group(placed, {"_id": "$__bucket"} | spec.get("output", {"count": {"$sum": 1}})), {"_id": 1})


def bucket_auto(frame: Frame, spec: dict, context: Context | None = None) -> Frame:
    """$bucketAuto: so many groups of about equal size, equal values together; _id holds the least value of a group and of the next."""
    n = spec.get("buckets")
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise QueryError("$bucketAuto needs a positive number of buckets")
    if frame.carried:
        raise QueryError("$bucketAuto inside the pipeline of a $lookup is not supported")
    at = evaluate(spec["groupBy"], Scope(frame.fields))
    if at.bracket in _EMPTY:
        at = Value(F.lit(None).cast("string"), T.StringType())
    rows = frame.df.withColumn("__x", at.column)
    size = lambda rows: max(1, int(rows / n + 0.5))
    # a group is full at its size, and takes all that equal its last; the last group takes the rest
    turn = iter(range(n - 2))
    upto = [x for x, _ in cut_points(rows, "__x", lambda m: size(m) if n > 1 else m, lambda m, done: None if done >= m else m if next(turn, None) is None else done + size(m))]
    if not upto:
        return Frame(rows.select(F.lit(None).cast("string").alias("_id")).where(F.lit(False)))
    low = rows.schema["__x"].dataType
    place = F.lit(0)
    for x in upto[:-1]:  # as many as there are buckets
        place = place + (F.lit(True) if x is None else F.coalesce(F.col("__x") > F.lit(x).cast(low), F.lit(False))).cast("int") if x is not None else place + F.col("__x").isNotNull().cast("int")
    placed = rows.withColumn("__bucket", place)
    output = spec.get("output", {"count": {"$sum": 1}})
    made = group(frame.of(placed), {"_id": "$__bucket"} | output).df
    ends = placed.groupBy("__bucket").agg(F.min(F.struct("__x")).alias("a"), F.max(F.struct("__x")).alias("b"))
    after = F.lead("a").over(Window.partitionBy(F.lit(1)).orderBy("__bucket"))  # a row for each bucket
    ends = ends.select("__bucket", F.struct(F.col("a.__x").alias("min"), F.coalesce(after, F.col("b"))["__x"].alias("max")).alias("__id"))
    both = made.withColumnRenamed("_id", "__b").join(F.broadcast(ends), F.col("__b") == F.col("__bucket"))
    out = both.select(F.col("__id").alias("_id"), *[F.col(quoted(k)) for k in output], F.col("__bucket").alias(f"{HIDDEN}u0"))
    return Frame(out, ranked=True)


def set_window_fields(frame: Frame, spec: dict, context: Context | None = None) -> Frame:
    return window_fields(frame, spec, context, _sort_keys)


STAGES: dict[str, Callable[[Frame, Any, Context], Frame]] = {
    "$match": matching,
    "$project": project,
    "$addFields": add_fields,
    "$set": add_fields,
    "$unset": unset,
    "$sort": sort,
    "$limit": limit_stage,
    "$skip": skip,
    "$group": group,
    "$unwind": unwind,
    "$lookup": lookup,
    "$count": count,
    "$replaceRoot": replace_root,
    "$replaceWith": replace_root,
    "$unionWith": union_with,
    "$setWindowFields": set_window_fields,
    "$facet": facet,
    "$bucket": bucket,
    "$bucketAuto": bucket_auto,
}


def apply(frame: Frame, stage: Any, context: Context, below: set[str] | None = None) -> Frame:
    """One stage; ``below`` is what is read later of the array that a lookup makes."""
    match stage:
        case FlatLookup():
            return flat_lookup(frame, stage, context, below)
        case ExistsLookup():
            return exists_lookup(frame, stage, context)
        case CountLookup():
            return count_lookup(frame, stage, context)
        case SpreadGroup():
            return spread_group(frame, stage, context)
        case Stage("$lookup" | "$graphLookup", dict(spec)):
            return lookup(frame, spec, context, below)
        case Stage(op, spec) if op in STAGES:
            return STAGES[op](frame, spec, context)
    raise QueryError(f"Unrecognized pipeline stage name: '{stage.op}'")
