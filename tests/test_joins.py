import datetime
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import joins
from millrace.plans.compiler import Compiler
from millrace.sources.catalog import Catalog


def spans(rng, n, long):
    """Short and long spans, points, a hot value, empty and open ones."""
    out = []
    for _ in range(n):
        lo = rng.choice([5.0, rng.uniform(-50, 50), rng.gauss(0, 0.01)])
        out.append((lo, lo + rng.choice([0.0, 0.0, rng.random(), 10 ** rng.uniform(-6, long), -1.0])))
    return [*out, (None, 1.0), (1.0, None), (math.nan, 2.0), (-math.inf, -40.0), (45.0, math.inf), (-math.inf, math.inf)]


@pytest.mark.parametrize("heavy", [4096, 4])
@pytest.mark.parametrize("long", [0, 3])
def test_range_join(spark, monkeypatch, heavy, long):
    monkeypatch.setattr(joins, "HEAVY", heavy)
    rng = random.Random(long)
    a, b = ([(i, *s) for i, s in enumerate(spans(rng, 150, long))] for _ in range(2))
    left, right = spark.createDataFrame(a, "i long, a double, b double"), spark.createDataFrame(b, "j long, c double, d double")
    got = joins.range_join(left, right, (F.col("a"), F.col("b")), (F.col("c"), F.col("d")), F.col("i") % 3 != F.col("j") % 3).select("i", "j").collect()
    fine = lambda lo, hi: lo is not None and hi is not None and lo <= hi
    want = [(i, j) for i, lo, hi in a if fine(lo, hi) for j, c, d in b if fine(c, d) and lo <= d and c <= hi and i % 3 != j % 3]
    assert Counter(tuple(r) for r in got) == Counter(want) and len(want) > 500


def test_range_join_of_times_and_of_nothing(spark):
    t = lambda *a: datetime.datetime(2024, 1, 1, *a)
    points = spark.createDataFrame([(1, t(3)), (2, t(5, 30)), (3, None)], "i long, t timestamp")
    hours = spark.createDataFrame([(7, t(2), t(3)), (8, t(3, 0, 1), t(6))], "j long, a timestamp, b timestamp")
    join = lambda p, h: sorted(tuple(r) for r in joins.range_join(p, h, (F.col("t"), F.col("t")), (F.col("a"), F.col("b"))).select("i", "j").collect())
    assert join(points, hours) == [(1, 7), (2, 8)]
    assert join(points.limit(0), hours) == [] and join(points, hours.limit(0)) == []


def test_range_join_makes_more_tasks_of_more_pairs(spark, monkeypatch):
    """Every fourth row has one value: the pairs of its bin are cut into cells, and no pair is lost or comes twice."""
    monkeypatch.setattr(joins, "CELL", 50)
    rng = random.Random(4)
    a, b = ([(i, rng.choice([1.0, rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(0, 20)])) for i in range(n)] for n in (120, 40))
    left, right = spark.createDataFrame(a, "i long, x double"), spark.createDataFrame(b, "j long, y double")
    met = joins.range_join(left, right, (F.col("x"), F.col("x")), (F.col("y"), F.col("y") + 1)).select("i", "j", F.spark_partition_id().alias("task"))
    want = [(i, j) for i, x in a for j, y in b if y <= x <= y + 1]
    rows = met.collect()
    assert Counter((r["i"], r["j"]) for r in rows) == Counter(want) and len(want) > 300
    assert max(Counter(r["task"] for r in rows).values()) < len(want) / 6  # of 4 shuffle partitions one would have a quarter at least


def test_range_join_plan(spark):
    a, b = spark.range(1000).select(F.col("id").alias("i"), F.rand(1).alias("x")), spark.range(1000).select(F.col("id").alias("j"), F.rand(2).alias("y"))
    plan = joins.range_join(a, b, (F.col("x"), F.col("x")), (F.col("y") - 0.001, F.col("y") + 0.001))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" in plan


@pytest.mark.parametrize("outer", [False, True])
def test_asof_join(spark, outer):
    """A key with half of the rows, equal times, null times and null keys, keys of one side alone."""
    rng = random.Random(5)
    rows = lambda n, m: [(i, None if rng.random() < 0.05 else rng.choice([0, 0, 0, 1, 2, 3, m]), None if rng.random() < 0.05 else rng.randrange(60)) for i in range(n)]
    a, b = rows(400, 8), rows(150, 9)
    left, right = spark.createDataFrame(a, "i long, k long, t int").repartition(3), spark.createDataFrame(b, "j long, k long, u int").repartition(2)
    got = joins.asof_join(left, right, "t", "u", ["k"], "r_", outer)
    assert got.columns == ["k", "i", "t", "r_j", "r_u"]
    want = []
    for i, k, t in a:
        found = max(((u, j) for j, m, u in b if m == k and u is not None and t is not None and u <= t), default=None)
        if found or outer:
            want.append((k, i, t, *((found[1], found[0]) if found else (None, None))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_asof_join_cuts_hot_keys(spark):
    left, right = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("t")), spark.range(0, 4000, 7).select(F.lit(1).alias("k"), F.col("id").alias("u"))
    got = joins.asof_join(left, right, "t", "u", ["k"], "r_")
    assert got.where("r_u <> t - t % 7").count() == 0 and got.count() == 4000
    assert joins.asof_join(left, right.limit(0), "t", "u", ["k"], "r_").count() == 0


def test_lookup_by_range_alone(spark):
    """Inequalities of one field without an equality are a range join, with nulls as expressions see them."""
    rng = random.Random(9)
    a = [(i, rng.choice([None, rng.uniform(0, 10)]), rng.choice([None, rng.uniform(0, 10)])) for i in range(40)]
    b = [(j, rng.choice([None, 5.0, rng.uniform(0, 10)]), rng.randrange(3)) for j in range(60)]
    made = Catalog(spark)
    made.register("d", "a", spark.createDataFrame(a, "i long, lo double, hi double"), ["i"])
    made.register("d", "b", spark.createDataFrame(b, "j long, x double, s long"), ["j"])
    look = "{'$lookup': {'from': 'b', 'let': {'l': '$lo', 'h': '$hi', 'i': '$i'}, 'pipeline': [{'$match': {'$expr': {'$and': [{'$gte': ['$x', '$$l']}, {'$gt': ['$$h', '$x']}, {'$ne': ['$s', {'$mod': ['$$i', 3]}]}]}}}], 'as': 'm'}}"
    result = Compiler(made, "d").compile(f"db.a.aggregate([{look}, {{'$unwind': '$m'}}, {{'$project': {{'i': 1, 'j': '$m.j'}}}}])")
    below = lambda x, y: y is not None and (x is None or x < y)
    want = [(i, j) for i, lo, hi in a for j, x, s in b if not below(x, lo) and below(x, hi) and s != i % 3]
    assert Counter((r["i"], r["j"]) for r in result.materialize()) == Counter(want) and want
