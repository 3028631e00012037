import datetime
import json

import pytest

from millrace.plans.ir import QueryError
from millrace.sources.catalog import Catalog
from millrace.streaming.pipelines import attach


def test_attach(spark, tmp_path):
    spark.createDataFrame([(1, "a", 2.0), (2, "b", 5.0), (3, "a", 7.0)], "id long, k string, v double").write.parquet(str(tmp_path / "in"))
    catalog = Catalog(spark)
    catalog.register("d", "names", spark.createDataFrame([("a", "Ann")], "k string, name string"))
    stream = spark.readStream.schema("id long, k string, v double").parquet(str(tmp_path / "in"))
    stages = [{"$match": {"v": {"$gt": 1}}}, {"$lookup": {"from": "names", "localField": "k", "foreignField": "k", "as": "n"}}, {"$unwind": "$n"}, {"$group": {"_id": "$n.name", "s": {"$sum": "$v"}}}]
    query = attach(stream, stages, catalog, "d").writeStream.outputMode("complete").format("memory").queryName("attached").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM attached").collect()] == [("Ann", 9.0)]
    with pytest.raises(QueryError):
        attach(stream, [{"$sort": {"v": 1}}])


T0 = datetime.datetime(2024, 1, 1, 12)
#: Batches of (id, minutes after T0, key, value): out of order, repeated, and too late in the end.
BATCHES = [
    [(1, 1, "a", 1), (2, 9, "b", 2), (3, 4, "a", 3)],
    [(4, 12, "a", 4), (2, 9, "b", 2), (5, 3, "b", 5)],
    [(6, 31, "a", 6), (4, 12, "a", 4)],
    [(7, 2, "a", 100), (8, 33, "b", 8)],
    [(9, 90, "a", 9)],
    [(10, 200, "z", 1)],
    [(11, 201, "z", 1)],
]
LATE = {"allowedLateness": {"size": 10, "unit": "minute"}, "time": "$ts"}
GROUP = [{"$match": {"v": {"$gt": 0}}}, {"$group": {"_id": "$k", "n": {"$sum": 1}, "s": {"$sum": "$v"}}}]
PIPELINES = {
    "tumbling": [{"$tumblingWindow": LATE | {"interval": {"size": 10, "unit": "minute"}, "pipeline": GROUP}}],
    "hopping": [{"$hoppingWindow": LATE | {"interval": {"size": 20, "unit": "minute"}, "hop": {"size": 10, "unit": "minute"}, "pipeline": [*GROUP, {"$match": {"n": {"$gt": 0}}}]}}],
    "session": [{"$sessionWindow": LATE | {"gap": {"size": 10, "unit": "minute"}, "partitionBy": "$k", "pipeline": GROUP}}],
    "once": [{"$dropDuplicates": LATE | {"on": ["id"]}}, {"$tumblingWindow": LATE | {"interval": {"size": 60, "unit": "minute"}, "pipeline": [{"$group": {"_id": None, "n": {"$sum": 1}, "s": {"$sum": "$v"}}}]}}],
}


def fed(spark, tmp_path, name):
    """The rows that a stream of the batches gives in append mode, restarted from its checkpoint after each batch."""
    for i, rows in enumerate(BATCHES):
        (tmp_path / "in").mkdir(exist_ok=True)
        lines = [json.dumps({"id": a, "ts": (T0 + datetime.timedelta(minutes=m)).isoformat() + "Z", "k": k, "v": v}) for a, m, k, v in rows]
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(lines))
        stream = spark.readStream.schema("id long, ts timestamp, k string, v long").json(str(tmp_path / "in"))
        query = attach(stream, PIPELINES[name]).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("windowStart", "windowEnd", "_id", "n", "s").collect()]


def minutes(rows):
    at = lambda t: (t - T0).total_seconds() / 60
    return sorted((at(a), at(b), k, n, s) for a, b, k, n, s in rows)


@pytest.mark.parametrize(
    ("name", "want"),
    [
        # the event at 2 minutes comes when the watermark stands at 21: its window is closed
        ("tumbling", [(0, 10, "a", 2, 4), (0, 10, "b", 3, 9), (10, 20, "a", 2, 8), (30, 40, "a", 1, 6), (30, 40, "b", 1, 8), (90, 100, "a", 1, 9)]),
        ("hopping", [(-10, 10, "a", 2, 4), (-10, 10, "b", 3, 9), (0, 20, "a", 4, 12), (0, 20, "b", 3, 9), (10, 30, "a", 2, 8), (20, 40, "a", 1, 6), (20, 40, "b", 1, 8), (30, 50, "a", 1, 6), (30, 50, "b", 1, 8), (80, 100, "a", 1, 9), (90, 110, "a", 1, 9)]),
        ("session", [(1, 22, "a", 4, 12), (3, 19, "b", 3, 9), (31, 41, "a", 1, 6), (33, 43, "b", 1, 8), (90, 100, "a", 1, 9)]),
        ("once", [(0, 60, None, 7, 29), (60, 120, None, 1, 9)]),
    ],
)
def test_event_time(spark, tmp_path, name, want):
    assert minutes(fed(spark, tmp_path, name)) == want


def test_a_table_gives_the_same(spark):
    rows = [(a, T0 + datetime.timedelta(minutes=m), k, v) for b in BATCHES for a, m, k, v in b if v != 100 and k != "z"]
    df = spark.createDataFrame(rows, "id long, ts timestamp, k string, v long")
    got = attach(df, PIPELINES["session"]).select("windowStart", "windowEnd", "_id", "n", "s").collect()
    assert minutes(map(tuple, got)) == [(1, 22, "a", 4, 12), (3, 19, "b", 3, 9), (31, 41, "a", 1, 6), (33, 43, "b", 1, 8), (90, 100, "a", 1, 9)]


@pytest.mark.parametrize("stage", [{"$tumblingWindow": {"time": "$k", "interval": {"size": 1, "unit": "hour"}, "pipeline": GROUP}}, {"$tumblingWindow": {"time": "$ts", "interval": {"size": 1, "unit": "year"}, "pipeline": GROUP}}, {"$sessionWindow": {"time": "$ts", "gap": {"size": 1, "unit": "hour"}, "pipeline": []}}, {"$dropDuplicates": {"time": "$ts", "on": ["gone"]}}])
def test_refusals(spark, stage):
    df = spark.createDataFrame([(T0, "a", 1)], "ts timestamp, k string, v long")
    with pytest.raises(QueryError):
        attach(df, [stage])


def test_a_stream_has_one_watermark(spark, tmp_path):
    stream = spark.readStream.schema("id long, ts timestamp, k string, v long").json(str(tmp_path))
    other = {"time": "$ts", "on": ["id"], "allowedLateness": {"size": 1, "unit": "hour"}}
    with pytest.raises(QueryError, match="share"):
        attach(stream, [{"$dropDuplicates": other}, *PIPELINES["tumbling"]])
