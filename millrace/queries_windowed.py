"""Registered queries of window fields, facets, buckets, reductions and corpus scores, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import overlap, retrieval, scoring
from .operators.windows import exact_quantiles
from .plans.compiler import Compiler
from .session import shared_folder
from .sources import dumps
from .sources.catalog import Catalog
from .streaming.pipelines import attach

#: name: (query text, SQL)
TEXTS: dict[str, tuple[str, str]] = {
    "window_running_by_key": (
        "db.orders.aggregate([{'$setWindowFields': {'partitionBy': '$o_custkey', 'sortBy': {'o_orderdate': 1}, 'output': {'spent': {'$sum': '$o_totalprice', 'window': {'documents': ['unbounded', 'current']}}, 'best': {'$max': '$o_totalprice', 'window': {'documents': ['unbounded', 'current']}}, 'n': {'$documentNumber': {}}}}}, {'$project': {'_id': 0, 'o_orderkey': 1, 'spent': {'$round': ['$spent', 2]}, 'best': 1, 'n': 1}}])",
        "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS spent, max(o_totalprice) OVER w AS best, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey ROWS UNBOUNDED PRECEDING)",
    ),
    "window_running_global": (
        "db.events.aggregate([{'$setWindowFields': {'sortBy': {'ts': 1}, 'output': {'seen': {'$count': {}, 'window': {'documents': ['unbounded', 'current']}}, 'users': {'$max': '$user_id', 'window': {'documents': ['unbounded', 'current']}}, 'share': {'$sum': '$user_id'}}}}, {'$project': {'_id': 0, 'event_id': 1, 'seen': 1, 'users': 1, 'share': 1}}])",
        "SELECT event_id, count(*) OVER w AS seen, max(user_id) OVER w AS users, CAST(sum(user_id) OVER () AS BIGINT) AS share FROM events WINDOW w AS (ORDER BY ts NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING)",
    ),
    "window_near_documents": (
        "db.events.aggregate([{'$setWindowFields': {'sortBy': {'ts': 1}, 'output': {'near': {'$sum': '$user_id', 'window': {'documents': [-2, 2]}}, 'low': {'$min': '$value', 'window': {'documents': [-5, 'current']}}, 'last': {'$shift': {'output': '$event_type', 'by': -1, 'default': 'none'}}}}}, {'$project': {'_id': 0, 'event_id': 1, 'near': 1, 'low': 1, 'last': 1}}])",
        "SELECT event_id, CAST(sum(user_id) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS near, min(value) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS low, lag(event_type, 1, 'none') OVER w AS last FROM events WINDOW w AS (ORDER BY ts NULLS FIRST, event_id)",
    ),
    "window_ranks": (
        "db.part.aggregate([{'$setWindowFields': {'partitionBy': '$p_brand', 'sortBy': {'p_size': -1}, 'output': {'r': {'$rank': {}}, 'd': {'$denseRank': {}}, 'mean': {'$avg': '$p_size'}}}}, {'$project': {'_id': 0, 'p_partkey': 1, 'r': 1, 'd': 1, 'mean': {'$round': ['$mean', 6]}}}])",
        "SELECT p_partkey, rank() OVER w AS r, dense_rank() OVER w AS d, round(avg(p_size) OVER (PARTITION BY p_brand), 6) AS mean FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC NULLS LAST)",
    ),
    "window_ranks_global": (
        "db.lineitem.aggregate([{'$setWindowFields': {'sortBy': {'l_quantity': 1}, 'output': {'r': {'$rank': {}}, 'd': {'$denseRank': {}}}}}, {'$group': {'_id': {'r': '$r', 'd': '$d'}, 'n': {'$sum': 1}}}, {'$project': {'_id': 0, 'r': '$_id.r', 'd': '$_id.d', 'n': 1}}])",
        "SELECT r, d, count(*) AS n FROM (SELECT rank() OVER w AS r, dense_rank() OVER w AS d FROM lineitem WINDOW w AS (ORDER BY l_quantity NULLS FIRST)) GROUP BY 1, 2",
    ),
    "window_by_time": (
        "db.events.aggregate([{'$setWindowFields': {'partitionBy': '$user_id', 'sortBy': {'ts': 1}, 'output': {'day': {'$count': {}, 'window': {'range': [-1, 0], 'unit': 'day'}}, 'high': {'$max': '$value', 'window': {'range': [-6, 6], 'unit': 'hour'}}}}}, {'$project': {'_id': 0, 'event_id': 1, 'day': 1, 'high': 1}}])",
        "SELECT event_id, count(*) OVER (w RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day, max(value) OVER (w RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND INTERVAL 6 HOUR FOLLOWING) AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)",
    ),
    "window_moving_average": (
        "db.customer.aggregate([{'$setWindowFields': {'partitionBy': '$c_nationkey', 'sortBy': {'c_custkey': 1}, 'output': {'e': {'$expMovingAvg': {'input': '$c_acctbal', 'alpha': 0.25}}}}}, {'$project': {'_id': 0, 'c_custkey': 1, 'e': {'$round': ['$e', 4]}}}])",
        """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
r AS (SELECT c_custkey, c_nationkey, i, c_acctbal AS e FROM n WHERE i = 1 UNION ALL SELECT n.c_custkey, n.c_nationkey, n.i, n.c_acctbal * 0.25 + r.e * 0.75 FROM r JOIN n ON n.c_nationkey = r.c_nationkey AND n.i = r.i + 1)
SELECT c_custkey, round(CAST(e AS DOUBLE), 4) AS e FROM r""",
    ),
    "facet_grouped": (
        "db.lineitem.aggregate([{'$facet': {'flags': [{'$group': {'_id': '$l_returnflag', 'n': {'$sum': 1}, 'top': {'$max': '$l_extendedprice'}}}], 'large': [{'$match': {'l_quantity': {'$gt': 40}}}, {'$group': {'_id': '$l_linestatus', 'n': {'$sum': 1}}}], 'late': [{'$match': {'l_discount': {'$gte': 0.05}}}, {'$count': 'n'}]}}, {'$project': {'all': {'$concatArrays': [{'$map': {'input': '$flags', 'in': {'k': {'$concat': ['flag ', '$$this._id']}, 'n': '$$this.n', 'top': '$$this.top'}}}, {'$map': {'input': '$large', 'in': {'k': {'$concat': ['large ', '$$this._id']}, 'n': '$$this.n', 'top': None}}}, {'$map': {'input': '$late', 'in': {'k': 'late', 'n': '$$this.n', 'top': None}}}]}}}, {'$unwind': '$all'}, {'$replaceRoot': {'newRoot': '$all'}}])",
        "SELECT 'flag ' || l_returnflag AS k, count(*) AS n, max(l_extendedprice) AS top FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'large ' || l_linestatus, count(*), NULL FROM lineitem WHERE l_quantity > 40 GROUP BY l_linestatus UNION ALL SELECT 'late', count(*), NULL FROM lineitem WHERE l_discount >= 0.05",
    ),
    "facet_of_documents": (
        "db.orders.aggregate([{'$match': {'o_orderstatus': 'P'}}, {'$facet': {'dear': [{'$sort': {'o_totalprice': -1}}, {'$limit': 3}, {'$project': {'_id': 0, 'o_orderkey': 1}}], 'n': [{'$count': 'n'}]}}, {'$unwind': '$dear'}, {'$project': {'k': '$dear.o_orderkey', 'n': {'$arrayElemAt': ['$n.n', 0]}}}])",
        "SELECT o_orderkey AS k, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)",
    ),
    "bucket_given": (
        "db.part.aggregate([{'$bucket': {'groupBy': '$p_size', 'boundaries': [1, 10, 25, 40], 'default': -1, 'output': {'n': {'$sum': 1}, 'top': {'$max': '$p_retailprice'}}}}])",
        "SELECT CASE WHEN p_size >= 1 AND p_size < 10 THEN 1 WHEN p_size >= 10 AND p_size < 25 THEN 10 WHEN p_size >= 25 AND p_size < 40 THEN 25 ELSE -1 END AS _id, count(*) AS n, max(p_retailprice) AS top FROM part GROUP BY 1",
    ),
    "bucket_auto": (
        "db.lineitem.aggregate([{'$bucketAuto': {'groupBy': '$l_quantity', 'buckets': 6, 'output': {'n': {'$sum': 1}, 'tax': {'$max': '$l_tax'}}}}, {'$project': {'_id': 0, 'low': '$_id.min', 'high': '$_id.max', 'n': 1, 'tax': 1}}])",
        """WITH RECURSIVE d AS MATERIALIZED (SELECT l_quantity AS x, count(*) AS k, max(l_tax) AS tax, sum(count(*)) OVER (ORDER BY l_quantity) AS upto FROM lineitem GROUP BY 1),
t AS (SELECT max(upto) AS n, CAST(floor(max(upto) / 6 + 0.5) AS BIGINT) AS size FROM d),
c AS (
  SELECT 1 AS i, (SELECT min(upto) FROM d, t WHERE upto >= size) AS upto, CAST(0 AS HUGEINT) AS before UNION ALL
  SELECT i + 1, CASE WHEN i = 5 THEN n ELSE (SELECT min(d.upto) FROM d WHERE d.upto >= least(c.upto + t.size, t.n)) END, c.upto FROM c, t WHERE i < 6 AND c.upto < n
), b AS (SELECT i, min(x) AS low, max(x) AS top, sum(k) AS n, max(tax) AS tax FROM c JOIN d ON d.upto > c.before AND d.upto <= c.upto GROUP BY i)
SELECT low, coalesce(lead(low) OVER (ORDER BY i), top) AS high, CAST(n AS BIGINT) AS n, tax FROM b""",
    ),
    "reduce_lists": (
        "db.orders.aggregate([{'$group': {'_id': '$o_custkey', 'prices': {'$push': '$o_totalprice'}, 'states': {'$push': '$o_orderstatus'}}}, {'$project': {'total': {'$round': [{'$reduce': {'input': '$prices', 'initialValue': 0, 'in': {'$add': ['$$value', '$$this']}}}, 2]}, 'f': {'$reduce': {'input': '$states', 'initialValue': {'f': 0, 'other': 0}, 'in': {'f': {'$add': ['$$value.f', {'$cond': [{'$eq': ['$$this', 'F']}, 1, 0]}]}, 'other': {'$add': ['$$value.other', {'$cond': [{'$eq': ['$$this', 'F']}, 0, 0.5]}]}}}}}}, {'$project': {'total': 1, 'f': '$f.f', 'other': '$f.other'}}])",
        "SELECT o_custkey AS _id, round(sum(o_totalprice), 2) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus <> 'F') * 0.5::DOUBLE AS other FROM orders GROUP BY 1",
    ),
    "all_and_slices": (
        "db.orders.aggregate([{'$sort': {'o_orderkey': 1}}, {'$group': {'_id': '$o_custkey', 'p': {'$push': '$o_orderpriority'}}}, {'$match': {'p': {'$all': ['1-URGENT', '5-LOW']}}}, {'$project': {'first': {'$arrayElemAt': [{'$slice': ['$p', -2]}, 0]}, 'digit': {'$substrCP': [{'$arrayElemAt': ['$p', 0]}, 0, 1]}, 'n': {'$size': {'$reverseArray': '$p'}}}}])",
        "SELECT o_custkey AS _id, p[greatest(len(p) - 1, 1)] AS first, p[1][1:1] AS digit, len(p) AS n FROM (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS p FROM orders GROUP BY 1) WHERE list_contains(p, '1-URGENT') AND list_contains(p, '5-LOW')",
    ),
}


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of a skewed and of a repeating column."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    shares = [0.01, 0.25, 0.5, 0.9, 1.0]
    out = [(c, s, float(x)) for c in ("l_extendedprice", "l_discount") for s, x in zip(shares, exact_quantiles(rows, c, shares), strict=True)]
    return spark.createDataFrame(out, "field string, share double, value double")


#: name: (operator call, SQL)
CALLS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "exact_quantiles": (
        quantiles,
        " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({s} AS DOUBLE) AS share, quantile_disc({c}, {s}) AS value FROM lineitem" for c in ("l_extendedprice", "l_discount") for s in (0.01, 0.25, 0.5, 0.9, 1.0)),
    ),
}



def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of six hours by type, from the text that a stream takes as well."""
    pipeline = [{"$match": {"value": {"$gt": 1}}}, {"$group": {"_id": "$event_type", "n": {"$sum": 1}, "top": {"$max": "$value"}}}]
    text = [{"$tumblingWindow": {"time": "$ts", "interval": {"size": 6, "unit": "hour"}, "allowedLateness": {"size": 10, "unit": "minute"}, "pipeline": pipeline}}]
    return attach(spark.read.parquet(f"{sf_dir}/events.parquet"), text)


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user: events with less than five hours between them."""
    pipeline = [{"$group": {"_id": "$user_id", "n": {"$sum": 1}, "top": {"$max": "$value"}}}, {"$match": {"n": {"$gt": 1}}}]
    text = [{"$sessionWindow": {"time": "$ts", "gap": {"size": 5, "unit": "hour"}, "partitionBy": "$user_id", "pipeline": pipeline}}]
    return attach(spark.read.parquet(f"{sf_dir}/events.parquet"), text)


def ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against itself with some words changed: matched, predicted and expected n-grams by length."""
    pairs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("reference"), F.regexp_replace("text", r" (the|of) ", " a ").alias("prediction"))
    found = overlap.overlaps(pairs, 2)
    return found.select("n", *[F.col(c).cast("long").alias(c) for c in ("matched", "predicted", "expected")])


def ngram_match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against part types, with some keywords."""
    pairs = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("reference"), F.concat_ws(" ", "p_type", "p_brand", "p_size").alias("prediction"))
    scores = overlap.ngram_scores(pairs, ["Brand#11", "Brand#12"])
    return scores.select(*[F.round(c, 6).alias(c) for c in scores.columns])


def dump_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one status as a JSON array that is loaded as a collection, and queried."""
    path = f"{shared_folder(spark)}/dump-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    dumps.write_dump(rows, f"{path}/orders.json", array=True)
    catalog = Catalog(spark)
    dumps.load(catalog, "d", "orders", f"{path}/orders.json")
    text = "db.orders.aggregate([{'$group': {'_id': '$o_orderpriority', 'n': {'$sum': 1}, 'keys': {'$sum': '$o_orderkey'}, 'top': {'$max': '$o_totalprice'}}}])"
    return Compiler(catalog, "d").compile(text).dataframe()


def ragged_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose fields differ by type, as a dump: how many have a field, how many have it as null."""
    path = f"{shared_folder(spark)}/dump-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    lines = F.when(kind == "purchase", F.to_json(F.struct("event_id", "event_type", "value"))).when(kind == "error", F.to_json(F.struct("event_id", "event_type", F.lit(None).cast("double").alias("value")), {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct("event_id", "event_type")))
    dumps.write_lines(rows.select(lines.alias("value")), f"{path}/events.json")
    catalog = Catalog(spark)
    dumps.load(catalog, "d", "events", f"{path}/events.json")
    text = "db.events.aggregate([{'$match': {'value': {'$exists': True}}}, {'$group': {'_id': '$event_type', 'n': {'$sum': 1}, 'full': {'$sum': {'$cond': [{'$eq': ['$value', None]}, 0, 1]}}, 'all': {'$push': '$value'}}}, {'$project': {'n': 1, 'full': 1, 'listed': {'$size': '$all'}}}])"
    return Compiler(catalog, "d").compile(text).dataframe()


def split_leakage_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split by row instead of by key leaks: customers of orders in both halves, and more than once in each."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 5 == 0).alias("held_out"))
    return retrieval.leaks(orders)


def cases_in_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each region, whose query sums up its orders by customer; one of another field, one wrong, one refused, one whose inner value is absent."""
    regions = [r[0] for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey").orderBy("r_regionkey").collect()]
    text = "db.customer.aggregate([{'$lookup': {'from': 'nation', 'localField': 'c_nationkey', 'foreignField': 'n_nationkey', 'as': 'n'}}, {'$unwind': '$n'}, {'$match': {'n.n_regionkey': %s}}, {'$lookup': {'from': 'orders', 'localField': 'c_custkey', 'foreignField': 'o_custkey', 'as': 'o'}}, {'$project': {'_id': 0, 'c_custkey': 1, 'n': {'$size': '$o'}}}])"
    gold = {str(k): text % k for k in regions}
    queries = dict(gold)
    queries["1"] = (text % 1).replace("'n': {'$size'", "'count': {'$size'")
    queries["2"] = text % 3
    gold |= {"count": "db.orders.count_documents({})", "refused": "db.orders.find({})", "absent": "db.orders.find({})", "stage": "db.orders.find({})"}
    queries |= {"stage": "db.orders.aggregate([{'$filter': {'input': '$o', 'cond': True}}])", "count": "db.orders.count_documents({'o_orderkey': {'$gte': 0}})", "refused": "db.orders.find({}).count()", "absent": "db.orders.find({'o_totalprice': {'$gt': db.orders.find_one({'o_orderkey': -1})['o_totalprice']}})"}
    cases = [{"id": i, "database": "tables", "normalized_query": q} for i, q in queries.items()]
    made = Catalog(spark)
    for name, order in (("customer", "c_custkey"), ("nation", "n_nationkey"), ("orders", "o_orderkey")):
        made.register("tables", name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), [order])
    rows = [(r["id"], r["status"], r["size"], r["execution_accuracy"], len(r["result"]) if isinstance(r.get("result"), list) else None) for r in scoring.run_in_cluster(made, cases, gold)]
    return spark.createDataFrame(rows, "id string, status string, size long, accurate boolean, sampled long")


_GRAMS = r"""WITH d AS (SELECT row_number() OVER () AS r, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda t: t <> '') AS a, list_filter(string_split_regex(regexp_replace(coalesce(text, ''), ' (the|of) ', ' a ', 'g'), '\s+'), lambda t: t <> '') AS b FROM documents),
s AS (SELECT r, n, unnest(list_transform(range(1, len(a) - n + 2), lambda i: array_to_string(a[i:i + n - 1], ' '))) AS g, 1 AS x, 0 AS y FROM d, range(1, 3) t(n) UNION ALL
  SELECT r, n, unnest(list_transform(range(1, len(b) - n + 2), lambda i: array_to_string(b[i:i + n - 1], ' '))), 0, 1 FROM d, range(1, 3) t(n)),
m AS (SELECT r, n, g, sum(x) AS x, sum(y) AS y FROM s GROUP BY ALL),
p AS (SELECT r, n, sum(least(x, y)) AS matched, sum(y) AS predicted, sum(x) AS expected FROM m GROUP BY ALL)
SELECT CAST(n AS INTEGER) AS n, CAST(sum(coalesce(matched, 0)) AS BIGINT) AS matched, CAST(sum(greatest(coalesce(predicted, 0), 1)) AS BIGINT) AS predicted, CAST(sum(greatest(coalesce(expected, 0), 1)) AS BIGINT) AS expected
FROM (SELECT d.r, t.n FROM d, range(1, 3) t(n)) LEFT JOIN p USING (r, n) GROUP BY n"""
_SCORES = r"""WITH d AS (SELECT row_number() OVER () AS r, list_filter(string_split_regex(concat_ws(' ', p_name, p_type, p_brand), '\s+'), lambda t: t <> '') AS a, list_filter(string_split_regex(concat_ws(' ', p_type, p_brand, p_size), '\s+'), lambda t: t <> '') AS b FROM part),
s AS (SELECT r, n, unnest(list_transform(range(1, len(a) - n + 2), lambda i: array_to_string(a[i:i + n - 1], ' '))) AS g, 1 AS x, 0 AS y FROM d, range(1, 5) t(n) UNION ALL
  SELECT r, n, unnest(list_transform(range(1, len(b) - n + 2), lambda i: array_to_string(b[i:i + n - 1], ' '))), 0, 1 FROM d, range(1, 5) t(n)),
m AS (SELECT r, n, g, sum(x) AS x, sum(y) AS y, CASE WHEN n > 1 OR g IN ('Brand#11', 'Brand#12') THEN 1.0 ELSE 0.2 END AS w FROM s GROUP BY ALL),
p AS (SELECT r, n, sum(least(x, y)) AS m, sum(y) AS y, sum(least(x, y) * w) AS mw, sum(x * w) AS xw FROM m GROUP BY ALL),
c AS (SELECT n, sum(coalesce(m, 0)) AS m, sum(greatest(coalesce(y, 0), 1)) AS y, sum(coalesce(mw, 0)) AS mw, sum(greatest(coalesce(xw, 0), 1)) AS xw FROM (SELECT d.r, t.n FROM d, range(1, 5) t(n)) LEFT JOIN p USING (r, n) GROUP BY n),
z AS (SELECT sum(len(a)) AS h, sum(len(b)) AS k FROM d), e AS (SELECT CASE WHEN k > h THEN 1.0 ELSE exp(1 - h / k) END AS e FROM z)
SELECT round(any_value(e) * exp(avg(ln(CASE WHEN m > 0 THEN m ELSE 0.1 END / y))), 6) AS ngram_match_score, round(any_value(e) * exp(avg(ln(CASE WHEN mw > 0 THEN mw ELSE 0.1 END / xw))), 6) AS weighted_ngram_match_score FROM c, e"""
CALLS |= {
    "event_windows": (
        event_windows,
        "SELECT CAST(w AS TIMESTAMP) AS \"windowStart\", CAST(w + INTERVAL 6 HOUR AS TIMESTAMP) AS \"windowEnd\", event_type AS _id, count(*) AS n, max(value) AS top FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w FROM events WHERE value > 1) GROUP BY ALL",
    ),
    "event_sessions": (
        event_sessions,
        """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 5 HOUR THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT min(ts) AS "windowStart", max(ts) + INTERVAL 5 HOUR AS "windowEnd", user_id AS _id, count(*) AS n, max(value) AS top FROM s GROUP BY user_id, s HAVING count(*) > 1""",
    ),
    "ngram_overlap": (ngram_overlap, _GRAMS),
    "ngram_match_scores": (ngram_match_scores, _SCORES),
    "dump_round_trip": (dump_round_trip, "SELECT o_orderpriority AS _id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'P' GROUP BY 1"),
    "ragged_dump": (ragged_dump, "SELECT event_type AS _id, count(*) AS n, CASE WHEN event_type = 'purchase' THEN count(*) ELSE 0 END AS \"full\", count(*) AS listed FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1"),
    "cases_in_cluster": (
        cases_in_cluster,
        """WITH k AS (SELECT r_regionkey AS r, count(c_custkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
SELECT CAST(a.r AS VARCHAR) AS id, 'PASS' AS status, coalesce(b.n, 0) AS size, a.r NOT IN (1, 2) AS accurate, least(b.n, 20) AS sampled FROM k a JOIN k b ON b.r = CASE WHEN a.r = 2 THEN 3 ELSE a.r END
UNION ALL SELECT 'count', 'PASS', NULL, TRUE, NULL UNION ALL SELECT 'refused', 'FAIL', NULL, FALSE, NULL UNION ALL SELECT 'absent', 'FAIL', NULL, FALSE, NULL UNION ALL SELECT 'stage', 'FAIL', NULL, FALSE, NULL""",
    ),
    "split_leakage_found": (
        split_leakage_found,
        "SELECT count(*) FILTER (WHERE t > 0 AND p > 0) AS overlap, count(*) FILTER (WHERE p > 1) AS pool_duplicates, count(*) FILTER (WHERE t > 1) AS test_duplicates FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS t, count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS p FROM orders GROUP BY 1)",
    ),
}
