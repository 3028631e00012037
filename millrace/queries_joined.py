"""Registered queries of lookups from arrays, lookups with pipelines, graph lookups and ragged documents, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import joins

_LINKS = "{'from': 'lineitem', 'startWith': '$s_suppkey', 'connectFromField': 'l_suppkey', 'connectToField': 'l_partkey', 'restrictSearchWithMatch': {'l_quantity': {'$gt': 45}}, 'as': 'reached'"
_WALK = """WITH RECURSIVE e AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity > 45),
"""

#: name: (query text, SQL)
TEXTS: dict[str, tuple[str, str]] = {
    "lookup_array_counted": (
        "db.customer.aggregate([{'$lookup': {'from': 'labels', 'localField': 'c_custkey', 'foreignField': 'doc_id', 'as': 'l'}}, {'$lookup': {'from': 'part', 'localField': 'l.doc_id', 'foreignField': 'p_partkey', 'as': 'p'}}, {'$project': {'_id': 0, 'c_custkey': 1, 'n': {'$size': '$p'}}}])",
        "SELECT c_custkey, count(DISTINCT p_partkey) AS n FROM customer LEFT JOIN labels ON doc_id = c_custkey LEFT JOIN part ON p_partkey = doc_id GROUP BY 1",
    ),
    "lookup_array_unwound": (
        "db.lineitem.aggregate([{'$group': {'_id': '$l_orderkey', 'keys': {'$push': '$l_suppkey'}}}, {'$lookup': {'from': 'supplier', 'localField': 'keys', 'foreignField': 's_suppkey', 'as': 's'}}, {'$unwind': '$s'}, {'$group': {'_id': '$s.s_nationkey', 'orders': {'$sum': 1}, 'best': {'$max': '$s.s_acctbal'}}}])",
        "SELECT s_nationkey AS _id, count(*) AS orders, max(s_acctbal) AS best FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1",
    ),
    "lookup_array_shown": (
        "db.nation.aggregate([{'$group': {'_id': '$n_regionkey', 'keys': {'$push': '$n_nationkey'}}}, {'$lookup': {'from': 'supplier', 'localField': 'keys', 'foreignField': 's_nationkey', 'as': 's'}}, {'$project': {'names': {'$size': '$s.s_suppkey'}, 'low': {'$min': '$s.s_acctbal'}, 'high': {'$max': '$s.s_acctbal'}}}])",
        "SELECT n_regionkey AS _id, count(s_suppkey) AS names, min(s_acctbal) AS low, max(s_acctbal) AS high FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "lookup_array_anti": (
        "db.customer.aggregate([{'$lookup': {'from': 'labels', 'localField': 'c_custkey', 'foreignField': 'doc_id', 'as': 'l'}}, {'$lookup': {'from': 'nation', 'localField': 'l.doc_id', 'foreignField': 'n_nationkey', 'as': 'n'}}, {'$match': {'n': {'$size': 0}}}, {'$project': {'_id': 0, 'c_custkey': 1}}])",
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM labels JOIN nation ON n_nationkey = doc_id WHERE doc_id = c_custkey)",
    ),
    "lookup_pipeline_conditions": (
        "db.customer.aggregate([{'$lookup': {'from': 'orders', 'let': {'k': '$c_custkey', 'b': '$c_acctbal'}, 'pipeline': [{'$match': {'o_orderstatus': {'$ne': 'P'}, '$expr': {'$and': [{'$eq': ['$o_custkey', '$$k']}, {'$gt': ['$o_totalprice', {'$multiply': ['$$b', 40]}]}]}}}, {'$project': {'_id': 0, 'o_orderkey': 1, 'over': {'$subtract': ['$o_totalprice', '$$b']}}}], 'as': 'o'}}, {'$unwind': '$o'}, {'$project': {'_id': 0, 'c_custkey': 1, 'order': '$o.o_orderkey', 'over': {'$round': ['$o.over', 2]}}}])",
        "SELECT c_custkey, o_orderkey AS \"order\", round(o_totalprice - c_acctbal, 2) AS over FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40 WHERE o_orderstatus IS DISTINCT FROM 'P'",
    ),
    "lookup_pipeline_topk": (
        "db.customer.aggregate([{'$lookup': {'from': 'orders', 'let': {'k': '$c_custkey'}, 'pipeline': [{'$match': {'$expr': {'$eq': ['$o_custkey', '$$k']}}}, {'$sort': {'o_totalprice': -1}}, {'$limit': 2}], 'as': 'o'}}, {'$unwind': {'path': '$o', 'preserveNullAndEmptyArrays': True}}, {'$project': {'_id': 0, 'c_custkey': 1, 'order': '$o.o_orderkey', 'price': '$o.o_totalprice'}}])",
        "SELECT c_custkey, o_orderkey AS \"order\", o_totalprice AS price FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS r FROM orders) ON o_custkey = c_custkey AND r <= 2",
    ),
    "lookup_pipeline_grouped": (
        "db.customer.aggregate([{'$lookup': {'from': 'orders', 'let': {'k': '$c_custkey'}, 'pipeline': [{'$match': {'$expr': {'$eq': ['$$k', '$o_custkey']}}}, {'$group': {'_id': '$o_orderstatus', 'n': {'$sum': 1}, 'top': {'$max': '$o_totalprice'}}}, {'$match': {'n': {'$gt': 3}}}], 'as': 's'}}, {'$unwind': '$s'}, {'$project': {'_id': 0, 'c_custkey': 1, 'status': '$s._id', 'n': '$s.n', 'top': '$s.top'}}])",
        "SELECT c_custkey, o_orderstatus AS status, count(*) AS n, max(o_totalprice) AS top FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) > 3",
    ),
    "lookup_pipeline_anti": (
        "db.part.aggregate([{'$lookup': {'from': 'lineitem', 'let': {'k': '$p_partkey', 'size': '$p_size'}, 'pipeline': [{'$match': {'$expr': {'$and': [{'$eq': ['$l_partkey', '$$k']}, {'$lt': ['$l_quantity', '$$size']}]}}}], 'as': 'small'}}, {'$match': {'small': {'$size': 0}}}, {'$project': {'_id': 0, 'p_partkey': 1}}])",
        "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity < p_size)",
    ),
    "lookup_pipeline_alone": (
        "db.region.aggregate([{'$lookup': {'from': 'part', 'pipeline': [{'$sort': {'p_retailprice': -1}}, {'$limit': 3}, {'$project': {'_id': 0, 'p_partkey': 1}}], 'as': 'dear'}}, {'$unwind': '$dear'}, {'$project': {'_id': 0, 'r_regionkey': 1, 'p': '$dear.p_partkey'}}])",
        "SELECT r_regionkey, p_partkey AS p FROM region, (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 3)",
    ),
    "lookup_pipeline_nested": (
        "db.nation.aggregate([{'$lookup': {'from': 'customer', 'let': {'n': '$n_nationkey'}, 'pipeline': [{'$match': {'$expr': {'$eq': ['$c_nationkey', '$$n']}}}, {'$lookup': {'from': 'supplier', 'let': {'b': '$c_acctbal'}, 'pipeline': [{'$match': {'$expr': {'$and': [{'$eq': ['$s_nationkey', '$$n']}, {'$gt': ['$s_acctbal', '$$b']}]}}}], 'as': 's'}}, {'$match': {'s': {'$size': 0}}}, {'$count': 'n'}], 'as': 'c'}}, {'$unwind': '$c'}, {'$project': {'_id': 0, 'n_nationkey': 1, 'richest': '$c.n'}}])",
        "SELECT n_nationkey, count(*) AS richest FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > c_acctbal) GROUP BY 1",
    ),
    "graph_lookup_reach": (
        f"db.supplier.aggregate([{{'$graphLookup': {_LINKS}}}}}, {{'$project': {{'_id': 0, 's_suppkey': 1, 'n': {{'$size': '$reached'}}}}}}])",
        _WALK + "r AS (SELECT s_suppkey AS start, s_suppkey AS v FROM supplier UNION SELECT r.start, e.b FROM r JOIN e ON e.a = r.v) SELECT start AS s_suppkey, count(e.a) AS n FROM r LEFT JOIN e ON e.a = r.v GROUP BY 1",
    ),
    "graph_lookup_depth": (
        f"db.supplier.aggregate([{{'$graphLookup': {_LINKS}, 'depthField': 'depth', 'maxDepth': 2}}}}, {{'$unwind': '$reached'}}, {{'$group': {{'_id': {{'s': '$s_suppkey', 'd': '$reached.depth'}}, 'n': {{'$sum': 1}}, 'far': {{'$max': '$reached.l_suppkey'}}}}}}, {{'$project': {{'_id': 0, 's': '$_id.s', 'd': '$_id.d', 'n': 1, 'far': 1}}}}])",
        _WALK + "r AS (SELECT s_suppkey AS s, s_suppkey AS v, CAST(0 AS BIGINT) AS d FROM supplier UNION SELECT s, e.b, d + 1 FROM r JOIN e ON e.a = r.v WHERE d < 2), m AS (SELECT s, v, min(d) AS d FROM r GROUP BY 1, 2) SELECT s, d, count(*) AS n, max(b) AS far FROM m JOIN e ON e.a = m.v GROUP BY 1, 2",
    ),
    "exists_after_union": (
        "db.customer.aggregate([{'$unionWith': 'supplier'}, {'$match': {'$or': [{'s_acctbal': {'$exists': False}, 'c_acctbal': {'$gt': 5000}}, {'c_custkey': {'$exists': False}, 's_acctbal': {'$lt': 1000}}]}}, {'$group': {'_id': {'c': '$c_nationkey', 's': '$s_nationkey'}, 'n': {'$sum': 1}, 'names': {'$push': '$s_name'}}}, {'$project': {'_id': 0, 'c': '$_id.c', 's': '$_id.s', 'n': 1, 'names': {'$size': '$names'}}}])",
        "SELECT c_nationkey AS c, CAST(NULL AS INTEGER) AS s, count(*) AS n, CAST(0 AS BIGINT) AS names FROM customer WHERE c_acctbal > 5000 GROUP BY 1 UNION ALL SELECT NULL, s_nationkey, count(*), count(*) FROM supplier WHERE s_acctbal < 1000 GROUP BY 2",
    ),
    "exists_after_outer_unwind": (
        "db.customer.aggregate([{'$lookup': {'from': 'labels', 'localField': 'c_custkey', 'foreignField': 'doc_id', 'as': 'l'}}, {'$unwind': {'path': '$l', 'preserveNullAndEmptyArrays': True}}, {'$group': {'_id': '$c_mktsegment', 'n': {'$sum': 1}, 'toxic': {'$push': '$l.toxic'}, 'q': {'$addToSet': '$l.quality'}}}, {'$project': {'n': 1, 'labelled': {'$size': '$toxic'}, 'q': {'$size': '$q'}}}])",
        "SELECT c_mktsegment AS _id, count(*) AS n, count(doc_id) AS labelled, count(DISTINCT quality) AS q FROM customer LEFT JOIN labels ON doc_id = c_custkey GROUP BY 1",
    ),
    "missing_in_some": (
        "db.customer.aggregate([{'$lookup': {'from': 'labels', 'localField': 'c_custkey', 'foreignField': 'doc_id', 'as': 'l'}}, {'$unwind': {'path': '$l', 'preserveNullAndEmptyArrays': True}}, {'$match': {'l.toxic': {'$exists': False}}}, {'$project': {'_id': 0, 'c_custkey': 1}}])",
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = c_custkey)",
    ),
    "add_dotted_fields": (
        "db.nation.aggregate([{'$addFields': {'at.region': '$n_regionkey', 'at.half.key': {'$divide': ['$n_nationkey', 2]}}}, {'$match': {'at.region': {'$gt': 1}}}, {'$project': {'_id': 0, 'n_name': 1, 'r': '$at.region', 'h': '$at.half.key'}}])",
        "SELECT n_name, n_regionkey AS r, n_nationkey / 2 AS h FROM nation WHERE n_regionkey > 1",
    ),
    "lookup_pipeline_range": (
        "db.supplier.aggregate([{'$lookup': {'from': 'customer', 'let': {'b': '$s_acctbal', 'n': '$s_nationkey'}, 'pipeline': [{'$match': {'$expr': {'$and': [{'$gte': ['$c_acctbal', '$$b']}, {'$lt': ['$c_acctbal', {'$add': ['$$b', 25]}]}, {'$ne': ['$c_nationkey', '$$n']}]}}}], 'as': 'c'}}, {'$unwind': '$c'}, {'$project': {'_id': 0, 's_suppkey': 1, 'c': '$c.c_custkey'}}])",
        "SELECT s_suppkey, c_custkey AS c FROM supplier JOIN customer ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 25 AND c_nationkey <> s_nationkey",
    ),
    "push_sorted_down": (
        "db.customer.aggregate([{'$sort': {'c_nationkey': -1, 'c_custkey': 1}}, {'$group': {'_id': '$c_mktsegment', 'first': {'$first': '$c_custkey'}, 'keys': {'$push': '$c_custkey'}}}, {'$project': {'first': 1, 'tenth': {'$arrayElemAt': ['$keys', 9]}}}])",
        "SELECT c_mktsegment AS _id, (list(c_custkey ORDER BY c_nationkey DESC NULLS LAST, c_custkey))[1] AS first, (list(c_custkey ORDER BY c_nationkey DESC NULLS LAST, c_custkey))[10] AS tenth FROM customer GROUP BY 1",
    ),
}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def range_join_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened in the ten minutes before each purchase, by type."""
    bought = _events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("bought"), F.col("ts").alias("at"))
    other = _events(spark, sf_dir).where("event_type <> 'purchase'").select("event_id", "ts", "event_type")
    met = joins.range_join(other, bought, (F.col("ts"), F.col("ts")), (F.col("at") - F.expr("INTERVAL 10 MINUTES"), F.col("at")))
    return met.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("bought").alias("purchases"), F.sum("event_id").alias("ids"))


def range_join_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' and suppliers' bands of balance that overlap, which are wide for some and narrow for others."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("b"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("a"))
    met = joins.range_join(c, s, (F.col("b"), F.col("b") + F.col("c_nationkey")), (F.col("a"), F.col("a") + F.pow(F.lit(2.0), F.col("s_nationkey") % 11)))
    return met.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("last"))


def _asof(spark: SparkSession, sf_dir: str, key: Column) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("k", key)
    bought = rows.where("event_type = 'purchase'").select("event_id", "k", "ts")
    clicks = rows.where("event_type = 'click'").select("k", F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return joins.asof_join(bought, clicks, "ts", "at", ["k"], "click_", outer=True).select("event_id", "click_id")


def asof_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's last click before each purchase."""
    return _asof(spark, sf_dir, F.col("user_id"))


def asof_join_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one key for half of the users."""
    return _asof(spark, sf_dir, F.when(F.col("user_id") % 2 == 0, F.lit(-1)).otherwise(F.col("user_id")))


_ASOF = "WITH e AS (SELECT *, {0} AS k FROM events) SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') c ON p.k = c.k AND p.ts >= c.ts"

#: name: (operator call, SQL)
CALLS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "range_join_points": (
        range_join_points,
        "SELECT o.event_type, count(*) AS n, count(DISTINCT p.event_id) AS purchases, CAST(sum(o.event_id) AS BIGINT) AS ids FROM events p JOIN events o ON o.ts BETWEEN p.ts - INTERVAL 10 MINUTE AND p.ts WHERE p.event_type = 'purchase' AND o.event_type <> 'purchase' GROUP BY 1",
    ),
    "range_join_spans": (
        range_join_spans,
        "SELECT s_suppkey, count(*) AS n, max(c_custkey) AS last FROM customer JOIN supplier ON c_acctbal <= s_acctbal + pow(2, s_nationkey % 11) AND s_acctbal <= c_acctbal + c_nationkey GROUP BY 1",
    ),
    "asof_join_events": (asof_join_events, _ASOF.format("user_id")),
    "asof_join_hot_key": (asof_join_hot_key, _ASOF.format("CASE WHEN user_id % 2 = 0 THEN -1 ELSE user_id END")),
}
