import random
from collections import Counter

import pytest

from millrace.operators import stages
from millrace.plans.compiler import Compiler
from millrace.plans.ir import QueryError
from millrace.sources.catalog import Catalog

LEFT = [(1, [1, 2, 2, 9], 5), (2, [], 7), (3, None, 2), (4, [None, 3], 9), (5, [1, 2, 2, 9], 1), (6, [8], None), (7, [2, 1], 5)]
RIGHT = [(10, 1, [1, 2], "a", 4), (11, 2, [2, 9], "b", 6), (12, None, None, "c", 1), (13, 3, [], None, 9), (14, 1, [None], "a", 2), (15, 7, [3, 3, 1], "b", None)]


@pytest.fixture(scope="module")
def shop(spark):
    made = Catalog(spark)
    made.register("d", "left", spark.createDataFrame(LEFT, "id long, xs array<int>, cap int").repartition(3), ["id"])
    made.register("d", "right", spark.createDataFrame(RIGHT, "rid long, k long, ks array<long>, s string, n int").repartition(2), ["rid"])
    return made


@pytest.fixture(scope="module")
def run(shop):
    return lambda text, fuse=True: Compiler(shop, "d", fuse).compile(text).materialize()


def meets(xs, theirs):
    """Whether any element of an array matches any of a foreign field; null and missing are one."""
    mine = [None] if xs is None else xs
    return any(x in theirs for x in mine)


@pytest.mark.parametrize(("foreign", "theirs"), [("k", lambda r: [r[1]]), ("ks", lambda r: [None] if r[2] is None else r[2])])
def test_lookup_from_an_array(run, foreign, theirs):
    look = f"{{'$lookup': {{'from': 'right', 'localField': 'xs', 'foreignField': '{foreign}', 'as': 'm'}}}}"
    want = {i: sorted(r[0] for r in RIGHT if meets(xs, theirs(r))) for i, xs, _ in LEFT}
    for fuse in (True, False):
        got = run(f"db.left.aggregate([{look}])", fuse)
        assert {r["id"]: sorted(m["rid"] for m in r["m"]) for r in got} == want
        got = run(f"db.left.aggregate([{look}, {{'$unwind': '$m'}}, {{'$project': {{'_id': 0, 'id': 1, 'r': '$m.rid'}}}}])", fuse)
        assert Counter((r["id"], r["r"]) for r in got) == Counter((i, r) for i, rs in want.items() for r in rs)
        got = run(f"db.left.aggregate([{look}, {{'$project': {{'id': 1, 'n': {{'$size': '$m'}}}}}}])", fuse)
        assert {r["id"]: r["n"] for r in got} == {i: len(rs) for i, rs in want.items()}
        got = run(f"db.left.aggregate([{look}, {{'$match': {{'m': {{'$size': 0}}}}}}, {{'$project': {{'id': 1}}}}])", fuse)
        assert {r["id"] for r in got} == {i for i, rs in want.items() if not rs}
    assert [r["id"] for r in run(f"db.left.aggregate([{{'$sort': {{'id': -1}}}}, {look}])")] == [7, 6, 5, 4, 3, 2, 1]


def test_lookup_from_an_array_of_another_type(run):
    """Text never meets numbers; null meets null."""
    look = "{'$lookup': {'from': 'right', 'localField': 'xs', 'foreignField': 's', 'as': 'm'}}"
    assert {r["id"]: [m["rid"] for m in r["m"]] for r in run(f"db.left.aggregate([{look}])")} == {i: [13] if meets(xs, [None]) else [] for i, xs, _ in LEFT}


def test_plan_of_a_lookup_from_an_array(shop):
    """Unwound, counted or asked for, it builds no array of matches."""
    look = "{'$lookup': {'from': 'right', 'localField': 'xs', 'foreignField': 'k', 'as': 'm'}}"
    for tail in ("{'$unwind': '$m'}, {'$project': {'r': '$m.rid'}}", "{'$project': {'n': {'$size': '$m'}}}", "{'$match': {'m': {'$ne': []}}}, {'$project': {'id': 1}}"):
        plan = Compiler(shop, "d").compile(f"db.left.aggregate([{look}, {tail}])").dataframe()._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def piped(pipeline, let="{'i': '$id', 'c': '$cap'}", more=""):
    return f"{{'$lookup': {{'from': 'right', 'let': {let}, 'pipeline': {pipeline}, 'as': 'm'{more}}}}}"


def test_lookup_with_a_pipeline(run):
    by = lambda got: {r["id"]: sorted((m["rid"] for m in r["m"]), key=str) for r in got}
    eq = piped("[{'$match': {'$expr': {'$eq': ['$n', '$$c']}}}]")
    assert by(run(f"db.left.aggregate([{eq}])")) == {i: [r[0] for r in RIGHT if r[4] == c] for i, _, c in LEFT}
    both = piped("[{'$match': {'s': {'$ne': 'b'}, '$expr': {'$and': [{'$lt': ['$n', '$$c']}, {'$gt': ['$n', 1]}]}}}]")
    low = lambda n, c: n is not None and c is not None and 1 < n < c
    assert by(run(f"db.left.aggregate([{both}])")) == {i: [r[0] for r in RIGHT if r[3] != "b" and low(r[4], c)] for i, _, c in LEFT}
    top = piped("[{'$match': {'$expr': {'$lte': ['$k', '$$i']}}}, {'$sort': {'n': -1}}, {'$limit': 2}, {'$project': {'_id': 0, 'rid': 1, 'over': {'$subtract': ['$n', '$$i']}}}]")
    some = lambda i: sorted((r for r in RIGHT if r[1] is None or r[1] <= i), key=lambda r: (-(r[4] if r[4] is not None else -99), r[0]))
    assert by(run(f"db.left.aggregate([{top}])")) == {i: sorted(r[0] for r in some(i)[:2]) for i, _, _ in LEFT}
    skipped = piped("[{'$match': {'$expr': {'$lte': ['$k', '$$i']}}}, {'$sort': {'n': -1}}, {'$skip': 1}, {'$limit': 1}]")
    assert by(run(f"db.left.aggregate([{skipped}])")) == {i: [r[0] for r in some(i)[1:2]] for i, _, _ in LEFT}
    sums = piped("[{'$match': {'$expr': {'$gte': ['$n', '$$c']}}}, {'$group': {'_id': '$s', 'n': {'$sum': 1}}}]")
    got = run(f"db.left.aggregate([{sums}])")
    reach = lambda c: [r for r in RIGHT if c is None or r[4] is not None and r[4] >= c]
    assert {r["id"]: {m["_id"]: m["n"] for m in r["m"]} for r in got} == {i: dict(Counter(r[3] for r in reach(c))) for i, _, c in LEFT}
    counted = piped("[{'$match': {'$expr': {'$eq': ['$n', '$$c']}}}, {'$count': 'n'}]")
    got = run(f"db.left.aggregate([{counted}, {{'$unwind': {{'path': '$m', 'preserveNullAndEmptyArrays': True}}}}])")
    assert {r["id"]: r.get("m") for r in got} == {i: {"n": n} if (n := sum(r[4] == c for r in RIGHT)) else None for i, _, c in LEFT}


def test_lookup_with_fields_and_a_pipeline(run):
    look = piped("[{'$match': {'$expr': {'$lt': ['$n', '$$c']}}}]", more=", 'localField': 'cap', 'foreignField': 'k'")
    assert {r["id"]: [m["rid"] for m in r["m"]] for r in run(f"db.left.aggregate([{look}])")} == {i: [r[0] for r in RIGHT if r[1] == c and c is not None and (r[4] is None or r[4] < c)] for i, _, c in LEFT}


def test_lookup_with_a_pipeline_of_its_own(run):
    """Without variables the pipeline runs once; nested ones see those of the lookups around them."""
    alone = "{'$lookup': {'from': 'right', 'pipeline': [{'$sort': {'n': -1}}, {'$limit': 1}, {'$project': {'_id': 0, 'rid': 1}}], 'as': 'm'}}"
    assert all(r["m"] == [{"rid": 13}] for r in run(f"db.left.aggregate([{alone}])"))
    inner = "{'$lookup': {'from': 'left', 'let': {'k': '$k'}, 'pipeline': [{'$match': {'$expr': {'$and': [{'$eq': ['$cap', '$$k']}, {'$lt': ['$id', '$$i']}]}}}], 'as': 'w'}}"
    got = run(f"db.left.aggregate([{piped("[{'$match': {'$expr': {'$eq': ['$n', '$$c']}}}, " + inner + "]")}, {{'$unwind': '$m'}}])")
    assert {(r["id"], r["m"]["rid"], tuple(sorted(w["id"] for w in r["m"]["w"]))) for r in got} == {(i, r[0], tuple(j for j, _, d in LEFT if d == r[1] and j < i)) for i, _, c in LEFT for r in RIGHT if r[4] == c}


def test_plan_of_a_lookup_with_a_pipeline(shop):
    text = f"db.left.aggregate([{piped("[{'$match': {'$expr': {'$and': [{'$eq': ['$n', '$$c']}, {'$gt': ['$k', '$$i']}]}}}]")}, {{'$unwind': '$m'}}, {{'$project': {{'r': '$m.rid'}}}}])"
    plan = Compiler(shop, "d").compile(text).dataframe()._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "collect_list" not in plan


def graph(rng, n, m):
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(0, i) for i in range(n // 2)})


def walked(edges, start, most, allowed=lambda e: True):
    """Edges reached from a node, each with the depth at which it is first met."""
    out, seen, ring, depth = {}, {start}, [start], 0
    while ring and (most is None or depth <= most):
        met = [e for e in edges if e[0] in ring and allowed(e)]
        out |= {e: depth for e in met if e not in out}
        ring = sorted({b for _, b in met} - seen)
        seen |= set(ring)
        depth += 1
    return out


@pytest.mark.parametrize("most", [None, 0, 2])
def test_graph_lookup(spark, most):
    """Cycles, a hub, nodes without links, a bound on depth, and links that a filter takes out."""
    edges = graph(random.Random(3), 24, 40)
    made = Catalog(spark)
    made.register("d", "edges", spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "e long, a long, b int"), ["e"])
    made.register("d", "nodes", spark.createDataFrame([(i,) for i in [*range(24), 99]] + [(None,)], "n int"), ["n"])
    bound = "" if most is None else f", 'maxDepth': {most}"
    for where, allowed in (("", lambda e: True), (", 'restrictSearchWithMatch': {'b': {'$gt': 3}}", lambda e: e[1] > 3)):
        look = f"{{'$graphLookup': {{'from': 'edges', 'startWith': '$n', 'connectFromField': 'b', 'connectToField': 'a', 'as': 'm', 'depthField': 'd'{bound}{where}}}}}"
        got = Compiler(made, "d").compile(f"db.nodes.aggregate([{look}])").materialize()
        want = {n: walked(edges, n, most, allowed) for n in [*range(24), 99]}
        assert {r["n"]: {(m["a"], m["b"]): m["d"] for m in r["m"]} for r in got if r["n"] is not None} == want
        assert all(len(r["m"]) == len(want.get(r["n"], {})) for r in got)
        flat = Compiler(made, "d").compile(f"db.nodes.aggregate([{look}, {{'$unwind': '$m'}}, {{'$group': {{'_id': '$m.d', 'k': {{'$sum': 1}}}}}}])").materialize()
        assert {r["_id"]: r["k"] for r in flat} == dict(Counter(d for w in want.values() for d in w.values()))


def test_graph_lookup_through_arrays(spark):
    rows = [("a", ["b", "c"], ["x"]), ("b", ["a"], ["x", "y"]), ("c", [], ["y"]), ("d", ["d"], None)]
    made = Catalog(spark)
    made.register("d", "t", spark.createDataFrame(rows, "name string, next array<string>, tags array<string>"), ["name"])
    run = lambda look: Compiler(made, "d").compile(f"db.t.aggregate([{look}])").materialize()
    got = run("{'$graphLookup': {'from': 't', 'startWith': '$next', 'connectFromField': 'next', 'connectToField': 'name', 'as': 'm', 'depthField': 'd'}}")
    assert {r["name"]: {m["name"]: m["d"] for m in r["m"]} for r in got} == {"a": {"b": 0, "c": 0, "a": 1}, "b": {"a": 0, "b": 1, "c": 1}, "c": {}, "d": {"d": 0}}
    got = run("{'$graphLookup': {'from': 't', 'startWith': '$tags', 'connectFromField': 'tags', 'connectToField': 'tags', 'as': 'm', 'depthField': 'd'}}")
    assert {r["name"]: {m["name"]: m["d"] for m in r["m"]} for r in got if r["name"] != "d"} == {"a": {"a": 0, "b": 0, "c": 1}, "b": {"a": 0, "b": 0, "c": 0}, "c": {"b": 0, "c": 0, "a": 1}}
    with pytest.raises(QueryError, match="connectToField"):
        run("{'$graphLookup': {'from': 't', 'startWith': '$next', 'connectFromField': 'next', 'as': 'm'}}")


def test_limit_must_keep_something(run):
    with pytest.raises(QueryError, match="positive"):
        run("db.left.aggregate([{'$limit': 0}])")


def test_push_below_a_descending_sort_of_the_least_numbers(spark):
    made = Catalog(spark)
    made.register("d", "t", spark.createDataFrame([(-2147483648, -128, -32768, -(2**63)), (5, 5, 5, 5)], "w int, b byte, s short, l long"))
    for f in "wbsl":
        (r,) = Compiler(made, "d").compile(f"db.t.aggregate([{{'$sort': {{'{f}': -1}}}}, {{'$group': {{'_id': None, 'x': {{'$push': '${f}'}}, 'y': {{'$last': '${f}'}}}}}}])").materialize()
        assert r["x"][0] == 5 and r["y"] < 0


@pytest.mark.parametrize("hubs", [1, 3])
def test_graph_lookup_that_is_counted_lists_no_square_of_pairs(spark, monkeypatch, hubs):
    """Most nodes reach most others; beside them are tails, a part of its own, a null and nodes without links."""
    rng = random.Random(8)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(360)] + [(200 + i, 201 + i % 4) for i in range(6)] + [(None, 3), (90, None)]
    made = Catalog(spark)
    made.register("d", "edges", spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "e long, a long, b int"), ["e"])
    nodes = [*range(130), *range(199, 208), None]
    made.register("d", "nodes", spark.createDataFrame([(n,) for n in nodes], "n int"), ["n"])
    sizes, keep = [], stages.stored
    monkeypatch.setattr(stages, "stored", lambda df: sizes.append((out := keep(df)).count()) or out)
    monkeypatch.setattr(stages, "HUBS", hubs)
    look = "{'$graphLookup': {'from': 'edges', 'startWith': '$n', 'connectFromField': 'b', 'connectToField': 'a', 'as': 'm'}}"
    got = Compiler(made, "d").compile(f"db.nodes.aggregate([{look}, {{'$project': {{'_id': 0, 'n': 1, 'all': {{'$size': '$m'}}}}}}])").materialize()
    counted = list(sizes)
    listed = Compiler(made, "d", False).compile(f"db.nodes.aggregate([{look}, {{'$unwind': '$m'}}, {{'$group': {{'_id': '$n', 'k': {{'$sum': 1}}}}}}])").materialize()
    each = {r["_id"]: r["k"] for r in listed}
    assert {r["n"]: r["all"] for r in got} == {n: each.get(n, 0) for n in nodes}
    assert max(each.values()) > 200 and max(counted) < 1000 < max(sizes)


@pytest.mark.parametrize("op", ["$gt", "$gte", "$lt", "$lte"])
@pytest.mark.parametrize("turned", [False, True])
def test_a_lookup_that_only_asks_whether_a_bound_is_met_joins_no_pairs(shop, op, turned):
    """A row for each key, with nulls on both sides; the greatest or least value tells."""
    test = f"{{'{op}': ['$$c', '$n']}}" if turned else f"{{'{op}': ['$n', '$$c']}}"
    look = f"{{'$lookup': {{'from': 'right', 'let': {{'c': '$cap', 'm': {{'$subtract': ['$id', 1]}}}}, 'pipeline': [{{'$match': {{'$expr': {{'$and': [{{'$eq': ['$k', '$$m']}}, {test}]}}}}}}], 'as': 'r'}}}}"
    text = f"db.left.aggregate([{look}, {{'$match': {{'r': {{'$size': 0}}}}}}, {{'$project': {{'_id': 0, 'id': 1}}}}])"
    both = [sorted(r["id"] for r in Compiler(shop, "d", fuse).compile(text).materialize()) for fuse in (True, False)]
    assert both[0] == both[1] and 0 < len(both[0]) < len(LEFT) + 1
    plan = Compiler(shop, "d").compile(text).dataframe()._jdf.queryExecution().optimizedPlan().toString()
    assert "max(" in plan or "min(" in plan
