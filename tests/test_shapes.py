import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import stages
from millrace.operators.windows import exact_quantiles
from millrace.plans.compiler import Compiler
from millrace.plans.ir import QueryError
from millrace.sources.catalog import Catalog

rng = random.Random(4)
ROWS = [(i, rng.choice("abc"), rng.choice([None, 5, 5, 5, rng.randrange(40)]), [rng.randrange(9) for _ in range(rng.randrange(4))]) for i in range(200)]


@pytest.fixture(scope="module")
def shop(spark):
    made = Catalog(spark)
    made.register("d", "t", spark.createDataFrame(ROWS, "i long, k string, v int, xs array<int>").repartition(3), ["i"])
    made.register("d", "one", spark.createDataFrame([(1, [1, 2, 3], [0.5, 2.0], [[1], [2, 3], []], None, "añb,c,", [(1, "x"), (2, None)])], "i long, xs array<long>, ws array<double>, ll array<array<long>>, gone array<long>, s string, ds array<struct<a: long, b: string>>"))
    return made


@pytest.fixture(scope="module")
def run(shop):
    return lambda text: Compiler(shop, "d").compile(text).materialize()


def test_facet(run, monkeypatch):
    """Grouped branches come from one aggregate; others from documents that are stored once."""
    stored = []
    monkeypatch.setattr(stages, "stored", lambda df, plain=stages.stored: (stored.append(1), plain(df))[1])
    grouped = "'by': [{'$group': {'_id': '$k', 'n': {'$sum': 1}, 'top': {'$max': '$v'}}}, {'$sort': {'n': -1, '_id': 1}}], 'big': [{'$match': {'v': {'$gt': 20}}}, {'$match': {'k': {'$ne': 'a'}}}, {'$count': 'n'}], 'none': [{'$match': {'i': -1}}, {'$count': 'n'}], 'set': [{'$group': {'_id': None, 's': {'$addToSet': '$k'}}}, {'$project': {'_id': 0, 'm': {'$size': '$s'}}}]"
    (got,) = run(f"db.t.aggregate([{{'$facet': {{{grouped}}}}}])")
    counts = Counter(r[1] for r in ROWS)
    top = lambda k: max(r[2] for r in ROWS if r[1] == k and r[2] is not None)
    assert got["by"] == [{"_id": k, "n": n, "top": top(k)} for k, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    assert got["big"] == [{"n": sum(r[2] is not None and r[2] > 20 and r[1] != "a" for r in ROWS)}] and got["none"] == [] and got["set"] == [{"m": 3}]
    assert len(stored) == 1
    (got,) = run(f"db.t.aggregate([{{'$match': {{'k': 'a'}}}}, {{'$facet': {{{grouped}, 'last': [{{'$sort': {{'i': -1}}}}, {{'$limit': 2}}, {{'$project': {{'_id': 0, 'i': 1}}}}], 'all': [{{'$match': {{'v': None}}}}]}}}}])")
    mine = [r for r in ROWS if r[1] == "a"]
    assert got["last"] == [{"i": r[0]} for r in mine[:-3:-1]] and [r["i"] for r in got["all"]] == [r[0] for r in mine if r[2] is None]
    assert got["by"] == [{"_id": "a", "n": len(mine), "top": top("a")}] and len(stored) == 3
    with pytest.raises(QueryError):
        run("db.t.aggregate([{'$facet': {'x': [{'$facet': {}}]}}])")


def auto(rows, n):
    rows, out, at = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0)), [], 0
    size = max(1, int(len(rows) / n + 0.5))
    while at < len(rows):
        end = len(rows) if len(out) == n - 1 else min(len(rows), at + size)
        while end < len(rows) and rows[end][2] == rows[end - 1][2]:
            end += 1
        out.append(rows[at:end])
        at = end
    return [({"min": b[0][2], "max": out[i + 1][0][2] if i + 1 < len(out) else b[-1][2]}, len(b)) for i, b in enumerate(out)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 300])
def test_bucket_auto(run, n):
    """Skewed, repeated and null values."""
    got = run(f"db.t.aggregate([{{'$bucketAuto': {{'groupBy': '$v', 'buckets': {n}}}}}])")
    assert [(r["_id"], r["count"]) for r in got] == auto(ROWS, n)


def test_bucket_and_quantiles(shop, run, spark):
    got = run("db.t.aggregate([{'$match': {'v': {'$ne': None}}}, {'$bucket': {'groupBy': '$v', 'boundaries': [0, 5, 6, 30], 'default': -1, 'output': {'n': {'$sum': 1}}}}])")
    place = lambda v: next((a for a, b in ((0, 5), (5, 6), (6, 30)) if a <= v < b), -1)
    assert [(r["_id"], r["n"]) for r in got] == sorted(Counter(place(r[2]) for r in ROWS if r[2] is not None).items())
    with pytest.raises(Exception, match="outside"):
        run("db.t.aggregate([{'$bucket': {'groupBy': '$v', 'boundaries': [0, 5]}}])")
    df = shop.collection("d", "t").df
    full = sorted(r[2] for r in ROWS if r[2] is not None)
    shares = [0.5, 0.0, 1.0, 0.25, 0.9]
    assert exact_quantiles(df, "v", shares) == [full[max(1, -int(-len(full) * s // 1)) - 1] for s in shares]
    assert exact_quantiles(df.where(F.lit(False)), "v", [0.5]) == [None]


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("{'$reduce': {'input': '$xs', 'initialValue': 0, 'in': {'$add': ['$$value', '$$this']}}}", 6),
        ("{'$reduce': {'input': '$ws', 'initialValue': 1, 'in': {'$multiply': ['$$value', '$$this']}}}", 1.0),
        ("{'$reduce': {'input': '$ll', 'initialValue': [], 'in': {'$concatArrays': ['$$value', '$$this']}}}", [1, 2, 3]),
        ("{'$reduce': {'input': '$xs', 'initialValue': None, 'in': {'a': '$$this', 'b': {'$ifNull': ['$$value.a', -1]}}}}", {"a": 3, "b": 2}),
        ("{'$reduce': {'input': '$xs', 'initialValue': {'n': 0, 's': 0}, 'in': {'n': {'$add': ['$$value.n', 1]}, 's': {'$add': ['$$value.s', {'$multiply': ['$$this', 0.5]}]}}}}", {"n": 3, "s": 3.0}),
        ("{'$reduce': {'input': '$gone', 'initialValue': 0, 'in': {'$add': ['$$value', '$$this']}}}", None),
        ("{'$reduce': {'input': {'$split': ['$s', ',']}, 'initialValue': '', 'in': {'$concat': ['$$this', '$$value']}}}", "cañb"),
        ("{'$slice': ['$xs', 2]}", [1, 2]), ("{'$slice': ['$xs', -2]}", [2, 3]), ("{'$slice': ['$xs', -9]}", [1, 2, 3]), ("{'$slice': ['$xs', 1, 5]}", [2, 3]), ("{'$slice': ['$xs', -1, 1]}", [3]),
        ("{'$reverseArray': '$xs'}", [3, 2, 1]), ("{'$range': [0, 5, 2]}", [0, 2, 4]), ("{'$range': [3, 0, -1]}", [3, 2, 1]), ("{'$range': [2, 2]}", []),
        ("{'$substr': ['$s', 1, 2]}", "ñ"), ("{'$substrCP': ['$s', 1, 2]}", "ñb"), ("{'$substr': ['$s', 0, -1]}", "añb,c,"), ("{'$strLenCP': '$s'}", 6), ("{'$split': ['$s', ',']}", ["añb", "c", ""]),
    ],
)
def test_expressions_of_arrays_and_texts(run, expression, want):
    (got,) = run(f"db.one.aggregate([{{'$project': {{'_id': 0, 'x': {expression}}}}}])")
    assert got["x"] == want and type(got["x"]) is type(want)


def test_reduce_of_types_that_do_not_meet(run):
    with pytest.raises(QueryError, match="no column type"):
        run("db.one.aggregate([{'$project': {'x': {'$reduce': {'input': '$xs', 'initialValue': '', 'in': '$$this'}}}}])")


def test_all(run):
    for wanted in ([1], [1, 2], [8, 8], []):
        assert {r["i"] for r in run(f"db.t.find({{'xs': {{'$all': {wanted}}}}}, {{'i': 1}})")} == {r[0] for r in ROWS if wanted and set(wanted) <= set(r[3])}
    assert {r["i"] for r in run("db.t.find({'k': {'$all': ['a']}}, {'i': 1})")} == {r[0] for r in ROWS if r[1] == "a"}


@pytest.mark.parametrize("kind", ["string", "double", "date", "struct", "boolean", "arrays"])
def test_groups_follow_a_downward_sort_without_a_window(spark, kind):
    """$first and $push take what ranks first downwards, nulls last; only arrays inside documents need a window."""
    letters = ["", "a", "ab", "b", "B", "é", "ß", "a\x00", "~", "\U0001f600", None]
    ddl, some = {
        "string": ("string", letters),
        "double": ("double", [0.5, -1.0, float("nan"), float("inf"), float("-inf"), None]),
        "date": ("date", [datetime.date(1, 1, 1), datetime.date(1969, 5, 1), datetime.date(2024, 2, 29), None]),
        "struct": ("struct<a: string, b: int>", [*((a, b) for a in letters[:5] for b in (-(2**31), None, 3)), None]),
        "boolean": ("boolean", [True, False, None]),
        "arrays": ("struct<a: array<int>>", [([1],), ([1, 2],), ([],), (None,), None]),
    }[kind]
    rows = [(i, rng.choice("xy"), rng.choice(some)) for i in range(120)]
    df = spark.createDataFrame(rows, f"i long, k string, v {ddl}").repartition(4)
    made = Catalog(spark)
    made.register("d", "t", df, ["i"])
    frame = Compiler(made, "d").compile("db.t.aggregate([{'$sort': {'v': -1}}, {'$group': {'_id': '$k', 'f': {'$first': '$i'}, 'all': {'$push': '$i'}}}])").dataframe()
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert ("Window" in plan) == (kind == "arrays")
    got = {r["_id"]: (r["f"], r["all"]) for r in frame.collect()}
    for k in "xy":  # as Spark itself sorts
        want = [r["i"] for r in df.where(F.col("k") == k).orderBy(F.col("v").desc(), "i").collect()]
        assert got[k] == (want[0], want)
