"""The engine's registered queries over the driver's tables, each with the same query as SQL.

Most are query texts that go through frontend, rewriting and compiler; the
others call the retrieval and scoring operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_joined, queries_retrieved, queries_windowed
from .operators import results, retrieval, scoring
from .plans.compiler import Compiler
from .session import stored
from .sources.catalog import Catalog

#: The tables as collections, and the columns in whose order they are stored.
TABLES = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "labels": ["doc_id"],
}
DATABASE = "tables"


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """A catalog of the tables; nothing is read until a query does."""
    out = Catalog(spark)
    for name, order in TABLES.items():
        out.register(DATABASE, name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), order)
    return out


def run_text(spark: SparkSession, sf_dir: str, text: str, fuse: bool = True) -> DataFrame:
    return Compiler(catalog(spark, sf_dir), DATABASE, fuse).compile(text).dataframe()


#: name: (query text, SQL)
TEXTS: dict[str, tuple[str, str]] = {
    "find_filter_project": (
        "db.lineitem.find({'l_quantity': {'$gt': 49}, 'l_returnflag': 'R'}, {'_id': 0, 'l_orderkey': 1, 'l_linenumber': 1, 'l_extendedprice': 1})",
        "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R'",
    ),
    "find_ne_nullsafe": (
        "db.customer.find({'c_mktsegment': {'$ne': 'BUILDING'}}, {'c_custkey': 1, 'c_mktsegment': 1})",
        "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'",
    ),
    "find_range_and": (
        "db.part.find({'p_size': {'$gte': 10, '$lte': 12}, '$and': [{'p_retailprice': {'$lt': 1500}}]}, {'p_partkey': 1, 'p_size': 1})",
        "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 12 AND p_retailprice < 1500",
    ),
    "find_in_list": (
        "db.orders.find({'o_orderpriority': {'$in': ['1-URGENT', '2-HIGH']}}, {'o_orderkey': 1, 'o_orderpriority': 1})",
        "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    ),
    "find_nin_list": (
        "db.orders.find({'o_orderstatus': {'$nin': ['F', 'O']}}, {'o_orderkey': 1, 'o_orderstatus': 1})",
        "SELECT o_orderkey, o_orderstatus FROM orders WHERE coalesce(o_orderstatus NOT IN ('F', 'O'), TRUE)",
    ),
    "find_or": (
        "db.part.find({'$or': [{'p_size': 1}, {'p_retailprice': {'$gt': 1900}}]}, {'p_partkey': 1})",
        "SELECT p_partkey FROM part WHERE p_size = 1 OR p_retailprice > 1900",
    ),
    "find_not_nor": (
        "db.part.find({'p_size': {'$not': {'$gt': 5}}, '$nor': [{'p_brand': 'Brand#11'}]}, {'p_partkey': 1})",
        "SELECT p_partkey FROM part WHERE NOT coalesce(p_size > 5, FALSE) AND NOT coalesce(p_brand = 'Brand#11', FALSE)",
    ),
    "find_sort_limit": (
        "db.orders.find({}, {'o_orderkey': 1, 'o_totalprice': 1}).sort('o_totalprice', -1).limit(10)",
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10",
    ),
    "find_skip_limit": (
        "db.orders.find({}, {'o_orderkey': 1}).limit(5).skip(20).sort([('o_orderkey', 1)])",
        "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 20",
    ),
    "find_sort_keyword": (
        "db.supplier.find({'s_acctbal': {'$lt': 0}}, {'s_suppkey': 1}, sort=[('s_acctbal', 1), ('s_suppkey', -1)]).limit(3)",
        "SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 ORDER BY s_acctbal, s_suppkey DESC LIMIT 3",
    ),
    "find_one_first": (
        "db.customer.find_one({'c_acctbal': {'$gt': 9000}}, {'c_custkey': 1, 'c_name': 1})",
        "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000 ORDER BY c_custkey LIMIT 1",
    ),
    "find_one_value": (
        "db.nation.find_one({'n_name': {'$exists': True}})['n_regionkey']",
        "SELECT n_regionkey AS value FROM nation ORDER BY n_nationkey LIMIT 1",
    ),
    "count_documents": ("db.lineitem.count_documents({'l_discount': {'$gte': 0.05}})", "SELECT count(*) AS count FROM lineitem WHERE l_discount >= 0.05"),
    "distinct_values": ("db.customer.distinct('c_mktsegment')", "SELECT DISTINCT c_mktsegment AS value FROM customer"),
    "distinct_filtered": ("db.orders.find({'o_totalprice': {'$gt': 200000}}).distinct('o_orderpriority')", "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_totalprice > 200000"),
    "expr_column_compare": (
        "db.lineitem.aggregate([{'$match': {'$expr': {'$gt': ['$l_tax', '$l_discount']}}}, {'$group': {'_id': '$l_linestatus', 'n': {'$sum': 1}}}])",
        "SELECT l_linestatus AS _id, count(*) AS n FROM lineitem WHERE l_tax > l_discount GROUP BY 1",
    ),
    "scalar_subquery_gt": (
        "db.supplier.find({'s_nationkey': 1, 's_acctbal': {'$gt': db.supplier.find({'s_nationkey': 2}, {'s_acctbal': 1}).sort('s_acctbal', -1)[0]['s_acctbal']}}, {'s_suppkey': 1})",
        "SELECT s_suppkey FROM supplier WHERE s_nationkey = 1 AND s_acctbal > (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = 2)",
    ),
    "in_subquery_semi": (
        "db.customer.find({'c_custkey': {'$in': db.orders.distinct('o_custkey', {'o_orderstatus': 'P'})}}, {'c_custkey': 1})",
        "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    ),
    "nin_subquery_anti": (
        "db.customer.find({'c_custkey': {'$nin': db.orders.distinct('o_custkey', {'o_orderstatus': 'P'})}}, {'c_custkey': 1})",
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    ),
    "group_count": ("db.orders.aggregate([{'$match': {'o_orderstatus': 'F'}}, {'$group': {'_id': '$o_orderpriority', 'n': {'$sum': 1}}}, {'$sort': {'n': -1}}])", "SELECT o_orderpriority AS _id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"),
    "group_multi_agg": (
        "db.lineitem.aggregate([{'$group': {'_id': {'flag': '$l_returnflag', 'status': '$l_linestatus'}, 'qty': {'$sum': '$l_quantity'}, 'avg_price': {'$avg': '$l_extendedprice'}, 'low': {'$min': '$l_tax'}, 'high': {'$max': '$l_tax'}, 'n': {'$sum': 1}}}, {'$project': {'_id': 0, 'flag': '$_id.flag', 'status': '$_id.status', 'qty': {'$round': ['$qty', 2]}, 'avg_price': {'$round': ['$avg_price', 4]}, 'low': 1, 'high': 1, 'n': 1}}])",
        "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_tax) AS low, max(l_tax) AS high, count(*) AS n FROM lineitem GROUP BY 1, 2",
    ),
    "group_global": (
        "db.customer.aggregate([{'$group': {'_id': None, 'n': {'$sum': 1}, 'sizes': {'$sum': '$c_nationkey'}, 'top': {'$max': '$c_acctbal'}}}])",
        "SELECT CAST(NULL AS VARCHAR) AS _id, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS sizes, max(c_acctbal) AS top FROM customer",
    ),
    "group_key_only": ("db.part.aggregate([{'$group': {'_id': '$p_brand'}}])", "SELECT DISTINCT p_brand AS _id FROM part"),
    "group_having": (
        "db.orders.aggregate([{'$group': {'_id': '$o_custkey', 'n': {'$sum': 1}}}, {'$match': {'n': {'$gte': 15}}}, {'$project': {'_id': 0, 'custkey': '$_id', 'n': 1}}])",
        "SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15",
    ),
    "group_two_level_avg": (
        "db.orders.aggregate([{'$group': {'_id': '$o_custkey', 'n': {'$sum': 1}}}, {'$group': {'_id': None, 'mean': {'$avg': '$n'}, 'all': {'$push': {'k': '$_id', 'n': '$n'}}}}, {'$unwind': '$all'}, {'$match': {'$expr': {'$gt': ['$all.n', {'$multiply': ['$mean', 1.5]}]}}}, {'$project': {'_id': 0, 'k': '$all.k', 'n': '$all.n'}}])",
        "WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT k, n FROM c WHERE n > (SELECT avg(n) * 1.5 FROM c)",
    ),
    "group_push_sorted": (
        "db.nation.aggregate([{'$sort': {'n_nationkey': 1}}, {'$group': {'_id': '$n_regionkey', 'names': {'$push': '$n_name'}, 'first': {'$first': '$n_name'}}}])",
        "SELECT n_regionkey AS _id, list(n_name ORDER BY n_nationkey) AS names, arg_min(n_name, n_nationkey) AS first FROM nation GROUP BY 1",
    ),
    "group_addtoset_size": (
        "db.orders.aggregate([{'$group': {'_id': '$o_orderstatus', 'p': {'$addToSet': '$o_orderpriority'}}}, {'$project': {'k': {'$size': '$p'}}}])",
        "SELECT o_orderstatus AS _id, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1",
    ),
    "sort_group_first_argmax": (
        "db.part.aggregate([{'$sort': {'p_brand': 1, 'p_retailprice': -1}}, {'$group': {'_id': '$p_brand', 'part': {'$first': '$p_partkey'}, 'price': {'$first': '$p_retailprice'}}}])",
        "SELECT p_brand AS _id, p_partkey AS part, p_retailprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS r FROM part) WHERE r = 1",
    ),
    "topk_customers": (
        "db.orders.aggregate([{'$group': {'_id': '$o_custkey', 'n': {'$sum': 1}}}, {'$sort': {'n': -1}}, {'$limit': 3}])",
        "SELECT o_custkey AS _id, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, _id LIMIT 3",
    ),
    "lookup_array_size": (
        "db.customer.aggregate([{'$lookup': {'from': 'orders', 'localField': 'c_custkey', 'foreignField': 'o_custkey', 'as': 'os'}}, {'$project': {'_id': 0, 'c_custkey': 1, 'n': {'$size': '$os'}}}])",
        "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    ),
    "lookup_unwind_inner": (
        "db.orders.aggregate([{'$match': {'o_totalprice': {'$gt': 300000}}}, {'$lookup': {'from': 'lineitem', 'localField': 'o_orderkey', 'foreignField': 'l_orderkey', 'as': 'li'}}, {'$unwind': '$li'}, {'$project': {'_id': 0, 'o_orderkey': 1, 'line': '$li.l_linenumber', 'qty': '$li.l_quantity'}}])",
        "SELECT o_orderkey, l_linenumber AS line, l_quantity AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 300000",
    ),
    "lookup_unwind_outer": (
        "db.customer.aggregate([{'$lookup': {'from': 'labels', 'localField': 'c_custkey', 'foreignField': 'doc_id', 'as': 'o'}}, {'$unwind': {'path': '$o', 'preserveNullAndEmptyArrays': True}}, {'$project': {'_id': 0, 'c_custkey': 1, 'k': '$o.quality'}}])",
        "SELECT c_custkey, quality AS k FROM customer LEFT JOIN labels ON doc_id = c_custkey",
    ),
    "lookup_three_way": (
        "db.customer.aggregate([{'$lookup': {'from': 'nation', 'localField': 'c_nationkey', 'foreignField': 'n_nationkey', 'as': 'n'}}, {'$unwind': '$n'}, {'$lookup': {'from': 'region', 'localField': 'n.n_regionkey', 'foreignField': 'r_regionkey', 'as': 'r'}}, {'$unwind': '$r'}, {'$group': {'_id': '$r.r_name', 'n': {'$sum': 1}}}])",
        "SELECT r_name AS _id, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    ),
    "lookup_anti": (
        "db.customer.aggregate([{'$lookup': {'from': 'labels', 'localField': 'c_custkey', 'foreignField': 'doc_id', 'as': 'os'}}, {'$match': {'os': {'$size': 0}}}, {'$project': {'_id': 0, 'c_custkey': 1}}])",
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = c_custkey)",
    ),
    "lookup_semi": (
        "db.customer.aggregate([{'$lookup': {'from': 'labels', 'localField': 'c_custkey', 'foreignField': 'doc_id', 'as': 'os'}}, {'$match': {'os': {'$ne': []}}}, {'$project': {'_id': 0, 'c_custkey': 1}}])",
        "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM labels WHERE doc_id = c_custkey)",
    ),
    "group_then_lookup": (
        "db.supplier.aggregate([{'$group': {'_id': '$s_nationkey', 'n': {'$sum': 1}}}, {'$lookup': {'from': 'nation', 'localField': '_id', 'foreignField': 'n_nationkey', 'as': 'na'}}, {'$project': {'_id': 0, 'name': '$na.n_name', 'n': 1}}])",
        "SELECT list_filter([n_name], lambda x: x IS NOT NULL) AS name, n FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) LEFT JOIN nation ON n_nationkey = s_nationkey",
    ),
    "unwind_filter": (
        "db.customer.aggregate([{'$lookup': {'from': 'orders', 'localField': 'c_custkey', 'foreignField': 'o_custkey', 'as': 'o'}}, {'$unwind': '$o'}, {'$match': {'o.o_totalprice': {'$gt': 250000}}}, {'$group': {'_id': '$c_mktsegment', 'n': {'$sum': 1}}}])",
        "SELECT c_mktsegment AS _id, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 250000 GROUP BY 1",
    ),
    "array_path_match": (
        "db.customer.aggregate([{'$lookup': {'from': 'orders', 'localField': 'c_custkey', 'foreignField': 'o_custkey', 'as': 'o'}}, {'$match': {'o.o_totalprice': {'$gt': 300000}}}, {'$project': {'_id': 0, 'c_custkey': 1}}])",
        "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    ),
    "filter_expr_array": (
        "db.customer.aggregate([{'$lookup': {'from': 'orders', 'localField': 'c_custkey', 'foreignField': 'o_custkey', 'as': 'o'}}, {'$project': {'_id': 0, 'c_custkey': 1, 'n': {'$size': {'$filter': {'input': '$o', 'cond': {'$eq': ['$$this.o_orderstatus', 'F']}}}}}}])",
        "SELECT c_custkey, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    ),
    "to_int_cast": (
        "db.orders.aggregate([{'$project': {'_id': 0, 'o_orderkey': 1, 'k': {'$toInt': {'$toString': '$o_custkey'}}}}])",
        "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS k FROM orders",
    ),
    "to_double_cast": (
        "db.part.aggregate([{'$group': {'_id': None, 'mean': {'$avg': {'$toDouble': {'$toString': '$p_size'}}}}}, {'$project': {'_id': 0, 'mean': {'$round': ['$mean', 4]}}}])",
        "SELECT round(avg(CAST(p_size AS DOUBLE)), 4) AS mean FROM part",
    ),
    "type_bracket_mismatch": ("db.part.find({'p_size': {'$gte': '8'}}, {'p_partkey': 1})", "SELECT p_partkey FROM part WHERE FALSE"),
    "missing_field_exists": ("db.part.find({'p_Size': {'$exists': False}, 'p_size': {'$lt': 3}}, {'p_partkey': 1})", "SELECT p_partkey FROM part WHERE p_size < 3"),
    "unknown_collection": ("db.parts.count_documents({})", "SELECT CAST(0 AS BIGINT) AS count"),
    "arithmetic_cond": (
        "db.lineitem.aggregate([{'$addFields': {'net': {'$multiply': ['$l_extendedprice', {'$subtract': [1, '$l_discount']}]}, 'big': {'$cond': [{'$gte': ['$l_quantity', 25]}, 'big', 'small']}}}, {'$group': {'_id': '$big', 'net': {'$sum': '$net'}}}, {'$project': {'net': {'$round': ['$net', 1]}}}])",
        "SELECT CASE WHEN l_quantity >= 25 THEN 'big' ELSE 'small' END AS _id, round(sum(l_extendedprice * (1 - l_discount)), 1) AS net FROM lineitem GROUP BY 1",
    ),
    "string_expressions": (
        "db.nation.aggregate([{'$project': {'_id': 0, 's': {'$concat': [{'$toLower': '$n_name'}, '-', {'$toString': '$n_regionkey'}]}, 'd': {'$ifNull': ['$n_nothing', 'none']}}}])",
        "SELECT lower(n_name) || '-' || n_regionkey AS s, 'none' AS d FROM nation",
    ),
    "divide_by_zero_null": (
        "db.nation.aggregate([{'$project': {'_id': 0, 'n_nationkey': 1, 'q': {'$round': [{'$divide': ['$n_nationkey', '$n_regionkey']}, 6]}}}])",
        "SELECT n_nationkey, round(CASE WHEN n_regionkey = 0 THEN NULL ELSE n_nationkey / n_regionkey END, 6) AS q FROM nation",
    ),
    "count_stage": ("db.events.aggregate([{'$match': {'event_type': {'$ne': None}, 'value': {'$gt': 1}}}, {'$count': 'n'}])", "SELECT count(*) AS n FROM events WHERE event_type IS NOT NULL AND value > 1"),
    "union_with": (
        "db.customer.aggregate([{'$project': {'_id': 0, 'k': '$c_nationkey'}}, {'$unionWith': {'coll': 'supplier', 'pipeline': [{'$project': {'_id': 0, 'k': '$s_nationkey'}}]}}, {'$group': {'_id': '$k', 'n': {'$sum': 1}}}])",
        "SELECT k AS _id, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1",
    ),
    "replace_root": (
        "db.customer.aggregate([{'$lookup': {'from': 'orders', 'localField': 'c_custkey', 'foreignField': 'o_custkey', 'as': 'o'}}, {'$unwind': '$o'}, {'$replaceRoot': {'newRoot': '$o'}}, {'$project': {'_id': 0, 'o_orderkey': 1, 'o_custkey': 1}}])",
        "SELECT o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey",
    ),
    "group_push_against_stored_order": (
        "db.nation.aggregate([{'$sort': {'n_name': -1}}, {'$group': {'_id': '$n_regionkey', 'names': {'$push': '$n_name'}}}])",
        "SELECT n_regionkey AS _id, list(n_name ORDER BY n_name DESC) AS names FROM nation GROUP BY 1",
    ),
    "sort_match_group_first": (
        "db.orders.aggregate([{'$sort': {'o_totalprice': -1}}, {'$match': {'o_orderstatus': 'F'}}, {'$group': {'_id': '$o_custkey', 'order': {'$first': '$o_orderkey'}, 'low': {'$last': '$o_totalprice'}}}])",
        "SELECT o_custkey AS _id, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS order, min(o_totalprice) AS low FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    ),
    "literal_dollar_match": ("db.customer.aggregate([{'$match': {'c_mktsegment': {'$ne': '$c_name'}}}, {'$count': 'n'}])", "SELECT count(*) AS n FROM customer WHERE c_mktsegment IS DISTINCT FROM '$c_name'"),
    "sort_unknown_path": ("db.nation.aggregate([{'$sort': {'gone': 1}}, {'$limit': 4}, {'$project': {'_id': 0, 'n_name': 1}}])", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 4"),
    "cast_before_join": (
        "db.customer.aggregate([{'$project': {'_id': 0, 'c_custkey': 1, 'k': {'$toInt': {'$toString': '$c_custkey'}}}}, {'$lookup': {'from': 'labels', 'localField': 'k', 'foreignField': 'doc_id', 'as': 'l'}}, {'$unwind': '$l'}, {'$project': {'_id': 0, 'c_custkey': 1, 'toxic': '$l.toxic'}}])",
        "SELECT c_custkey, toxic FROM customer JOIN labels ON doc_id = c_custkey",
    ),
    "text_key_never_meets_number": (
        "db.customer.aggregate([{'$project': {'_id': 0, 'c_nationkey': 1, 'k': {'$toString': '$c_custkey'}}}, {'$lookup': {'from': 'labels', 'localField': 'k', 'foreignField': 'doc_id', 'as': 'l'}}, {'$group': {'_id': '$c_nationkey', 'n': {'$sum': 1}, 'found': {'$max': {'$size': '$l'}}}}])",
        "SELECT c_nationkey AS _id, count(*) AS n, 0 AS found FROM customer GROUP BY 1",
    ),
    "exclusion_projection": ("db.region.find({}, {'_id': 0, 'r_name': 0})", "SELECT r_regionkey FROM region"),
}


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "lang")
    return retrieval.stratified_split(docs, "lang")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each language are held out; the hash decides which, the quotas how many."""
    return _split(spark, sf_dir).groupBy("lang").agg(F.count_if("held_out").alias("held_out"), F.count(F.lit(1)).alias("n"))


def split_leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.leaks(_split(spark, sf_dir))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return rows.where(F.col("id") % 5 == 0), rows.where(F.col("id") % 5 != 0)


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of the other four fifths for every fifth vector."""
    queries, pool = _halves(spark, sf_dir)
    return retrieval.neighbours(queries, pool, 10).select("query_id", "rank", F.col("id").alias("vec_id"))


def knn_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, pool = _halves(spark, sf_dir)
    return retrieval.vote(retrieval.neighbours(queries, pool, 10), 10)


def knn_vote_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, pool = _halves(spark, sf_dir)
    voted = retrieval.vote(retrieval.neighbours(queries, pool, 10), 10)
    return retrieval.accuracy(voted, queries.select(F.col("id").alias("query_id"), "label"))


def k_sweep_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the vote for 3, 5 and 10 neighbours of one search."""
    queries, pool = _halves(spark, sf_dir)
    voted = retrieval.vote_sweep(retrieval.neighbours(queries, pool, 10), [3, 5, 10])
    truth = queries.select(F.col("id").alias("query_id"), "label")
    hit = F.col("predicted").eqNullSafe(F.col("label"))
    return voted.join(truth, "query_id").groupBy("k").agg(F.count_if(hit).alias("matches"), F.count(F.lit(1)).alias("n"))


def schema_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).cards().select("id", "doc_count", "text")


def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).counts(DATABASE)


def result_match_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a pipeline, fused and as written, gives the same rows, and differs from a shortened one."""
    text = TEXTS["lookup_unwind_inner"][0]
    a, b = (stored(run_text(spark, sf_dir, text, fuse)) for fuse in (True, False))  # each is read twice
    return spark.createDataFrame([(results.frames_match(a, b), results.frames_match(a, b.limit(1)))], "same boolean, shortened boolean")


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accuracy aggregates over the labels: quality as correct, toxic as not empty."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    records = rows.select((F.col("quality") == 1).alias("execution_accuracy"), (F.col("toxic") == 1).alias("non_empty_rate"), F.when(F.col("doc_id") % 7 == 0, "FAIL").otherwise("PASS").alias("status"))
    return scoring.summary(records)


def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scoring.arm_summary(rows.select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("Arm"), (F.col("quality") == 1).alias("execution_accuracy")))


def metric_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.group_means(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_brand", ["p_size", "p_retailprice"])


def normalize_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded text for each order, in the shell's dialect, fenced: its canonical form, and why it is refused."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus")
    quoted = F.concat(F.lit("```python\nlist(db.orders.find({'o_custkey': "), F.col("o_custkey").cast("string"), F.lit(", 'x': null, 'y': \"null\"}))\n```"))
    other = F.when(F.col("o_orderstatus") == "F", F.lit("db.orders.countDocuments()")).when(F.col("o_orderstatus") == "P", F.lit("db.orders.find({}).count()")).otherwise(quoted)
    made = scoring.normalized(rows.withColumn("generated_query", other))
    return made.select("id", "normalized_query", F.size("notes").cast("long").alias("n_notes"), "reason")


def case_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases run and compared with gold results: right, wrong, empty, refused, failing and without a database."""
    made = catalog(spark, sf_dir)
    texts = {
        "count": "db.customer.count_documents({})",
        "rows": "list(db.nation.find({'n_regionkey': 1}, {'_id': 0, 'n_name': 1}))",
        "wrong": "db.orders.count_documents({'o_orderstatus': 'P'})",
        "empty": "db.orders.find({'o_orderstatus': 'none'})",
        "refused": "db.orders.find({}).count()",
        "failing": "db.orders.aggregate([{'$group': {'n': {'$sum': 1}}}])",
        "skipped": "db.orders.find({})",
    }
    cases = [{"id": i, "database": None if i == "skipped" else DATABASE, "normalized_query": q} for i, q in texts.items()]
    right = {"wrong": "db.orders.count_documents({'o_orderstatus': 'F'})", "rows": "db.nation.find({'n_regionkey': 1}, {'_id': 0, 'n_name': 1}, sort=[('n_name', -1)])"}
    gold, _, _, _ = scoring.build_gold(made, [c | {"normalized_query": right.get(c["id"], c["normalized_query"])} for c in cases])
    records = scoring.run_cases(made, cases, gold)
    rows = [(r["id"], r["status"], r.get("non_empty_rate"), r.get("execution_accuracy"), r["result"] if isinstance(r.get("result"), int) else len(r["result"]) if "result" in r else None) for r in records]
    return spark.createDataFrame(rows, "id string, status string, non_empty_rate boolean, execution_accuracy boolean, size long")


def slice_and_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose id is a labelled one, paired with the order of the same number, and ids without a customer."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))
    wanted = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"))
    kept, lacking = scoring.slice_of(rows, wanted)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"))
    return scoring.paired(kept, orders).unionByName(lacking.select("id", F.lit(None).cast("string").alias("reference"), F.lit("no such row").alias("prediction")))


def merged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three score tables by brand, merged where all have the brand, with the three-component mean."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").withColumnRenamed("p_brand", "Model")
    execution = parts.groupBy("Model").agg(F.count(F.lit(1)).alias("n"))
    code = parts.where("p_size > 5").groupBy("Model").agg(F.round(F.max("p_size") / 100, 4).alias("ngram_match_score"), F.round(F.min("p_size") / 100, 4).alias("weighted_ngram_match_score"), F.round(F.avg("p_size") / 100, 4).alias("syntax_match_score"))
    bert = parts.where("p_retailprice > 950").groupBy("Model").agg(F.count(F.lit(1)).alias("dear"))
    return scoring.merged(execution, scoring.three_component_mean(code), bert)


_RANKED = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
r AS (
  SELECT q.vec_id AS query_id, q.label AS truth, p.vec_id, p.label,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, p.v) DESC, p.vec_id) AS INTEGER) AS "rank"
  FROM e q JOIN e p ON q.vec_id % 5 = 0 AND p.vec_id % 5 <> 0
), k AS (SELECT unnest([3, 5, 10]) AS k),
c AS (SELECT query_id, truth, k, label, count(*) AS n FROM r JOIN k ON "rank" <= k GROUP BY ALL),
m AS (SELECT query_id, truth, k, max(n) AS most FROM c GROUP BY ALL),
voted AS (
  SELECT m.query_id, m.truth, m.k, CASE WHEN (SELECT count(*) FROM c WHERE c.query_id = m.query_id AND c.k = m.k AND c.n = m.most) = 1
    THEN (SELECT min(label) FROM c WHERE c.query_id = m.query_id AND c.k = m.k AND c.n = m.most)
    ELSE (SELECT label FROM r WHERE r.query_id = m.query_id AND r."rank" = 1) END AS predicted FROM m
)"""
_CARD = """SELECT 'tables.{0}' AS id, (SELECT count(*) FROM {0}) AS doc_count, 'database: tables' || chr(10) || 'collection: {0}' || chr(10) || 'fields: {1}' AS text"""

#: name: (operator call, SQL)
CALLS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "stratified_split": (
        stratified_split,
        """WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
t AS (SELECT CAST(ceil(round(sum(n) * 0.2, 6)) - sum(floor(n * 0.2)) AS BIGINT) AS rest FROM s),
q AS (SELECT lang, n, row_number() OVER (ORDER BY n * 0.2 - floor(n * 0.2) DESC, n DESC, lang) AS turn FROM s)
SELECT lang, CAST(floor(n * 0.2) AS BIGINT) + CASE WHEN turn <= rest THEN 1 ELSE 0 END AS held_out, n FROM q, t""",
    ),
    "split_leakage_check": (split_leakage_check, "SELECT CAST(0 AS BIGINT) AS overlap, CAST(0 AS BIGINT) AS pool_duplicates, CAST(0 AS BIGINT) AS test_duplicates"),
    "knn_topk": (knn_topk, _RANKED + 'SELECT query_id, "rank", vec_id FROM r WHERE "rank" <= 10'),
    "knn_majority_vote": (knn_majority_vote, _RANKED + "SELECT query_id, predicted FROM voted WHERE k = 10"),
    "knn_vote_accuracy": (knn_vote_accuracy, _RANKED + "SELECT count(*) FILTER (WHERE predicted = truth) AS matches, count(*) AS n, round(count(*) FILTER (WHERE predicted = truth) / count(*), 4) AS accuracy FROM voted WHERE k = 10"),
    "k_sweep_accuracy": (k_sweep_accuracy, _RANKED + "SELECT k, count(*) FILTER (WHERE predicted = truth) AS matches, count(*) AS n FROM voted GROUP BY k"),
    "schema_cards": (
        schema_cards,
        " UNION ALL ".join([
            _CARD.format("region", "r_regionkey (int), r_name (str)"),
            _CARD.format("nation", "n_nationkey (int), n_name (str), n_regionkey (int)"),
            _CARD.format("orders", "o_orderkey (int), o_custkey (int), o_orderstatus (str), o_totalprice (float), o_orderdate (datetime), o_orderpriority (str)"),
            _CARD.format("customer", "c_custkey (int), c_name (str), c_nationkey (int), c_acctbal (float), c_mktsegment (str)"),
            _CARD.format("supplier", "s_suppkey (int), s_name (str), s_nationkey (int), s_acctbal (float)"),
            _CARD.format("lineitem", "l_orderkey (int), l_partkey (int), l_suppkey (int), l_linenumber (int), l_quantity (float), l_extendedprice (float), l_discount (float), l_tax (float), l_returnflag (str), l_linestatus (str), l_shipdate (datetime)"),
            _CARD.format("events", "event_id (int), ts (datetime), user_id (int), event_type (str), value (float), props (str)"),
            _CARD.format("labels", "doc_id (int), quality (int), toxic (int)"),
            _CARD.format("part", "p_partkey (int), p_name (str), p_brand (str), p_type (str), p_size (int), p_retailprice (float)"),
        ]),
    ),
    "collection_counts": (collection_counts, " UNION ALL ".join(f"SELECT '{t}' AS collection, count(*) AS n FROM {t}" for t in TABLES)),
    "result_match_multiset": (result_match_multiset, "SELECT TRUE AS same, FALSE AS shortened"),
    "score_summary": (
        score_summary,
        """SELECT round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 2) AS "Accuracy", round(100.0 * count(*) FILTER (WHERE toxic = 1) / count(*), 2) AS "NonEmptyRate",
round(100.0 * count(*) FILTER (WHERE doc_id % 7 <> 0) / count(*), 2) AS "RanOK" FROM labels""",
    ),
    "arm_summary": (
        arm_summary,
        """SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS "Arm", count(*) FILTER (WHERE quality = 1) AS "Correct", count(*) AS "Total",
round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 2) AS "Accuracy", round(sqrt(0.25 / count(*)) * 100, 4) AS "StandardError" FROM labels GROUP BY 1""",
    ),
    "normalize_cases": (
        normalize_cases,
        """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'db.orders.count_documents({})' WHEN 'P' THEN 'db.orders.find({}).count()'
ELSE 'db.orders.find({''o_custkey'': ' || o_custkey || ', ''x'': None, ''y'': ''null''})' END AS normalized_query,
CAST(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 0 ELSE 1 END AS BIGINT) AS n_notes, CASE WHEN o_orderstatus = 'P' THEN 'method not allowed: count' ELSE '' END AS reason FROM orders""",
    ),
    "case_records": (
        case_records,
        """SELECT 'count' AS id, 'PASS' AS status, TRUE AS non_empty_rate, TRUE AS execution_accuracy, (SELECT count(*) FROM customer) AS size
UNION ALL SELECT 'rows', 'PASS', TRUE, TRUE, (SELECT count(*) FROM nation WHERE n_regionkey = 1)
UNION ALL SELECT 'wrong', 'PASS', TRUE, FALSE, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'empty', 'PASS', FALSE, TRUE, 0 UNION ALL SELECT 'refused', 'FAIL', FALSE, FALSE, NULL
UNION ALL SELECT 'failing', 'FAIL', FALSE, FALSE, NULL UNION ALL SELECT 'skipped', 'SKIPPED', NULL, NULL, NULL""",
    ),
    "slice_and_pairs": (
        slice_and_pairs,
        """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS reference, o_orderpriority AS prediction FROM customer JOIN orders ON o_orderkey = c_custkey WHERE c_custkey IN (SELECT doc_id FROM labels)
UNION ALL SELECT DISTINCT CAST(doc_id AS VARCHAR), NULL, 'no such row' FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT c_custkey FROM customer)""",
    ),
    "merged_scores": (
        merged_scores,
        """WITH e AS (SELECT p_brand AS "Model", count(*) AS n FROM part GROUP BY 1), b AS (SELECT p_brand AS "Model", count(*) AS dear FROM part WHERE p_retailprice > 950 GROUP BY 1),
c AS (SELECT p_brand AS "Model", round(max(p_size) / 100, 4) AS ngram_match_score, round(min(p_size) / 100, 4) AS weighted_ngram_match_score, round(avg(p_size) / 100, 4) AS syntax_match_score FROM part WHERE p_size > 5 GROUP BY 1)
SELECT "Model", n, ngram_match_score, weighted_ngram_match_score, syntax_match_score, round((ngram_match_score + weighted_ngram_match_score + syntax_match_score) / 3, 4) AS codebleu_3component, dear
FROM e JOIN c USING ("Model") JOIN b USING ("Model")""",
    ),
    "metric_group_mean": (metric_group_mean, "SELECT p_brand, round(avg(p_size), 4) AS p_size, round(avg(p_retailprice), 4) AS p_retailprice FROM part GROUP BY 1"),
}


TEXTS |= queries_joined.TEXTS | queries_windowed.TEXTS | queries_retrieved.TEXTS
CALLS |= queries_joined.CALLS | queries_windowed.CALLS | queries_retrieved.calls(catalog, CALLS["schema_cards"][1])


def _text_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_text(spark, sf_dir, text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _text_query(text) for name, (text, _) in TEXTS.items()} | {name: f for name, (f, _) in CALLS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (TEXTS | CALLS).items()}
