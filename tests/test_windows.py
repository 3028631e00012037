import random

import pytest

from millrace.operators import windows
from millrace.plans.compiler import Compiler
from millrace.plans.ir import QueryError
from millrace.sources.catalog import Catalog

rng = random.Random(12)
ROWS = [(i, rng.choice([None, "a", "a", "a", "b"]), rng.choice([None, *range(9)]), rng.choice([None, rng.randrange(-50, 50)]), rng.choice([0.5, 2.25, None])) for i in range(90)]


@pytest.fixture(scope="module")
def run(spark):
    made = Catalog(spark)
    made.register("d", "t", spark.createDataFrame(ROWS, "i long, k string, s int, v long, w double").repartition(3), ["i"])
    return lambda text: Compiler(made, "d").compile(f"db.t.aggregate([{text}])").materialize()


def partitions(key):
    out = {}
    for r in ROWS:
        out.setdefault(r[1] if key else None, []).append(r)
    for rows in out.values():
        rows.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    return out


def framed(rows, i, low, high):
    at = lambda b, open_: open_ if b == "unbounded" else i + (0 if b == "current" else b)
    return rows[max(0, at(low, 0)) : max(0, at(high, len(rows) - 1) + 1)]


def value(op, some):
    known = [r[3] for r in some if r[3] is not None]
    return {"$sum": sum(known), "$count": len(some), "$avg": sum(known) / len(known) if known else None, "$min": min(known, default=None), "$max": max(known, default=None), "$push": [r[3] for r in some], "$first": some[0][3] if some else None, "$last": some[-1][3] if some else None}[op]


FRAMES = [("unbounded", "unbounded"), ("unbounded", "current"), (-2, 1), (-3, "current"), (1, 3), ("current", "unbounded"), (-1, -1)]


@pytest.mark.parametrize("stretch", [1 << 16, 5])
@pytest.mark.parametrize("key", [True, False])
def test_frames_of_documents(run, monkeypatch, key, stretch):
    """Every aggregate over every kind of frame, with ties, nulls, a null key and one partition of all."""
    monkeypatch.setattr(windows, "STRETCH", stretch)
    parts = partitions(key)
    outputs, want = [], {}
    for j, (low, high) in enumerate(FRAMES):
        for op in ("$sum", "$count", "$avg", "$min", "$max", "$push", "$first", "$last"):
            name = f"f{j}{op[1:]}"
            outputs.append(f"'{name}': {{'{op}': {'{}' if op == '$count' else repr('$v')}, 'window': {{'documents': [{low!r}, {high!r}]}}}}")
            for rows in parts.values():
                for i, r in enumerate(rows):
                    want.setdefault(r[0], {})[name] = value(op, framed(rows, i, low, high))
    got = run(f"{{'$setWindowFields': {{{"'partitionBy': '$k', " if key else ''}'sortBy': {{'s': 1}}, 'output': {{{', '.join(outputs)}}}}}}}")
    assert len(got) == len(ROWS)
    for r in got:
        for name, x in want[r["i"]].items():
            assert r[name] == (pytest.approx(x) if isinstance(x, float) else x), (r["i"], name)


@pytest.mark.parametrize("key", [True, False])
@pytest.mark.parametrize("way", [1, -1])
def test_ranks_shifts_and_fills(run, key, way):
    outputs = "'r': {'$rank': {}}, 'd': {'$denseRank': {}}, 'n': {'$documentNumber': {}}, 'up': {'$shift': {'output': '$v', 'by': 1, 'default': 7}}, 'down': {'$shift': {'output': '$v', 'by': -2}}, 'l': {'$locf': '$v'}, 'e': {'$expMovingAvg': {'input': '$v', 'N': 3}}"
    got = {r["i"]: r for r in run(f"{{'$setWindowFields': {{{"'partitionBy': '$k', " if key else ''}'sortBy': {{'s': {way}}}, 'output': {{{outputs}}}}}}}")}
    for rows in partitions(key).values():
        if way < 0:
            rows = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        last = average = None
        for i, r in enumerate(rows):
            g = got[r[0]]
            rank = next(j for j, q in enumerate(rows) if q[2] == r[2]) + 1
            assert (g["r"], g["d"], g["n"]) == (rank, len({q[2] for q in rows[:rank]}), i + 1)
            assert g["up"] == (rows[i + 1][3] if i + 1 < len(rows) else 7) and g["down"] == (rows[i - 2][3] if i >= 2 else None)
            last = r[3] if r[3] is not None else last
            assert g["l"] == last
            if r[3] is not None:
                average = r[3] if average is None else r[3] * 0.5 + average * 0.5
            assert g["e"] == (pytest.approx(average) if r[3] is not None else None)


def test_frames_by_value(run):
    got = {r["i"]: r for r in run("{'$match': {'s': {'$ne': None}}}, {'$setWindowFields': {'partitionBy': '$k', 'sortBy': {'s': 1}, 'output': {'n': {'$sum': '$v', 'window': {'range': [-1, 2]}}, 'm': {'$max': '$v', 'window': {'range': ['unbounded', 'current']}}}}}")}
    for r in ROWS:
        if r[2] is not None:
            near = [q for q in ROWS if q[1] == r[1] and q[2] is not None and -1 <= q[2] - r[2] <= 2]
            upto = [q[3] for q in ROWS if q[1] == r[1] and q[2] is not None and q[2] <= r[2] and q[3] is not None]
            assert got[r[0]]["n"] == sum(q[3] for q in near if q[3] is not None) and got[r[0]]["m"] == max(upto, default=None)


def test_frames_by_time_and_lines(spark):
    made = Catalog(spark)
    rows = spark.sql("SELECT id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 20) AS t, IF(id % 3 = 1, NULL, id * 10) AS v FROM range(8)")
    made.register("d", "t", rows, ["id"])
    got = Compiler(made, "d").compile("db.t.aggregate([{'$setWindowFields': {'sortBy': {'t': 1}, 'output': {'n': {'$count': {}, 'window': {'range': [-1, 0], 'unit': 'hour'}}, 'f': {'$linearFill': '$v'}}}}, {'$sort': {'id': 1}}])").materialize()
    assert [r["n"] for r in got] == [1, 2, 3, 4, 4, 4, 4, 4]
    assert [r["f"] for r in got] == [0, 10, 20, 30, 40, 50, 60, None]


@pytest.mark.parametrize("spec", ["{'output': {'x': {'$rank': {}}}}", "{'sortBy': {'s': 1}, 'output': {'x': {'$median': '$v'}}}", "{'output': {'x': {'$sum': '$v', 'window': {'documents': [-1, 0]}}}}", "{'sortBy': {'s': -1}, 'output': {'x': {'$sum': '$v', 'window': {'range': [-1, 0]}}}}", "{'sortBy': {'s': 1}}"])
def test_refusals(run, spec):
    with pytest.raises(QueryError):
        run(f"{{'$setWindowFields': {spec}}}")


def test_one_partition_is_not_one_task(spark):
    """The dealt table of a partition of all has rows in every range."""
    made = Catalog(spark)
    made.register("d", "t", spark.range(1000).withColumnRenamed("id", "i"), ["i"])
    seen, plain = [], windows.stored

    def told(df):
        out = plain(df)
        seen.append(sorted(r["count"] for r in out.groupBy("__part").count().collect()))
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(windows, "stored", told)
        (top,) = Compiler(made, "d").compile("db.t.aggregate([{'$setWindowFields': {'sortBy': {'i': 1}, 'output': {'n': {'$sum': '$i', 'window': {'documents': ['unbounded', 'current']}}}}}, {'$group': {'_id': None, 'n': {'$max': '$n'}}}])").materialize()
    assert top["n"] == 499500 and len(seen[0]) > 1 and seen[0][-1] < 700
