"""Registered queries of prompts, embeddings, generation and score tables, with their SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import retrieval, scoring
from .session import shared_folder
from .sources import settings
from .sources.catalog import Catalog

#: name: (query text, SQL)
TEXTS: dict[str, tuple[str, str]] = {
    "project_own_id": (
        "db.customer.aggregate([{'$match': {'c_acctbal': {'$lt': 0}}}, {'$project': {'_id': '$c_custkey', 'name': {'$toUpper': '$c_name'}, 'gone': '$c_nothing'}}])",
        "SELECT c_custkey AS _id, upper(c_name) AS name FROM customer WHERE c_acctbal < 0",
    ),
    "root_pushed_and_back": (
        "db.supplier.aggregate([{'$group': {'_id': '$s_nationkey', 'docs': {'$push': '$$ROOT'}}}, {'$unwind': '$docs'}, {'$replaceRoot': {'newRoot': '$docs'}}, {'$match': {'s_acctbal': {'$gt': 0}}}])",
        "SELECT * FROM supplier WHERE s_acctbal > 0",
    ),
}


def prompt_rows(spark: SparkSession, sf_dir: str, cards: DataFrame) -> DataFrame:
    """A prompt for every fifth vector, with its three nearest of the others as examples."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit("tables").alias("label"))
    question = F.concat(F.lit("vector "), F.col("id").cast("string"))
    asked, pool = rows.where(F.col("id") % 5 == 0), rows.where(F.col("id") % 5 != 0)
    near = retrieval.neighbours(asked, pool, 3)
    cases = asked.select("id", question.alias("question"), F.when(F.col("id") % 2 == 0, "tables").otherwise("other").alias("database"), F.lit("easy").alias("complexity"))
    known = pool.select("id", question.alias("question"), F.concat(F.lit("db.v.find({'id': "), F.col("id").cast("string"), F.lit("})")).alias("normalized_query"))
    notes = retrieval.numeric_note(cards, {"tables": ["orders.o_custkey", "orders.o_gone"]}, "\nNumbers as text: {fields}.")
    made = retrieval.prompts(cases, near, known, cards, "Write one query.\n", "Answer with the query alone.", notes, 3)
    return made.select("id", "question", "predicted_database", "database_match", "retrieved_ids", "system_prompt")


def embedded_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through the embedding hook, with a model whose token states are the characters."""

    def model(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        longest = max(map(len, texts), default=0) or 1
        states, mask = np.full((len(texts), longest, 2), 99.0), np.zeros((len(texts), longest))
        for i, t in enumerate(texts):
            states[i, : len(t), 0], states[i, : len(t), 1], mask[i, : len(t)] = list(map(ord, t)), 50.0, 1
        return states, mask

    made = retrieval.embed(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand"), "p_brand", model)
    return made.select("p_partkey", F.round(F.col("vector")[0].cast("double"), 4).alias("x"), F.round(F.col("vector")[1].cast("double"), 4).alias("y"))


def generated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts through the generation hook; the model fails on some."""

    def model(prompt: str) -> str:
        if prompt.endswith("7"):
            raise ValueError("no answer")
        return f"db.part.find({{'p_name': {prompt!r}}})"

    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("system_prompt"))
    return retrieval.generate(rows, model).select("id", "generated_query", "error")


def score_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by brand as a CSV table with a line of free text behind it, read back."""
    path = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    means = scoring.group_means(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_brand", ["p_size", "p_retailprice"])
    settings.write_scores(means, path)
    return settings.read_scores(spark, path, "p_brand string, p_size double, p_retailprice double", "p_size")


def calls(catalog: Callable[[SparkSession, str], Catalog], cards_sql: str) -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """name: (operator call, SQL); the cards' lines are those of their own query."""
    lines = sorted(re.findall(r"SELECT 'tables\.(\w+)' AS id.*?'fields: ([^']*)'", cards_sql))
    block = f"Schema of tables, {len(lines)} collection(s):\n" + "".join(f"\n- {name}: {{ {fields} }}" for name, fields in lines)
    text = lambda s: "'" + s.replace("'", "''") + "'"
    prompts_sql = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
r AS (SELECT q.vec_id AS id, p.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, p.v) DESC, p.vec_id) AS r FROM e q JOIN e p ON q.vec_id % 5 = 0 AND p.vec_id % 5 <> 0)
SELECT id, 'vector ' || id AS question, 'tables' AS predicted_database, id % 2 = 0 AS database_match, list(vec_id ORDER BY r) AS retrieved_ids,
  {text("Write one query.\n" + "The 3 most similar questions asked before, with their queries:\n\n")} || string_agg(r || '. Question: vector ' || vec_id || chr(10) || 'Query: db.v.find({{''id'': ' || vec_id || '}})' || chr(10), chr(10) ORDER BY r)
  || chr(10) || {text(block)} || {text("\nNumbers as text: orders.o_custkey.")} || {text("\nAnswer with the query alone.")} AS system_prompt
FROM r WHERE r <= 3 GROUP BY id"""
    return {
        "prompt_rows": (lambda spark, sf_dir: prompt_rows(spark, sf_dir, catalog(spark, sf_dir).cards()), prompts_sql),
        "embedded_texts": (
            embedded_brands,
            "SELECT p_partkey, round(m / sqrt(m * m + 2500), 4) AS x, round(50 / sqrt(m * m + 2500), 4) AS y FROM (SELECT p_partkey, list_avg(list_transform(string_split(p_brand, ''), lambda c: ord(c))) AS m FROM part)",
        ),
        "generated_queries": (
            generated_queries,
            "SELECT c_custkey AS id, CASE WHEN c_name NOT LIKE '%7' THEN 'db.part.find({''p_name'': ''' || c_name || '''})' END AS generated_query, CASE WHEN c_name LIKE '%7' THEN 'no answer' END AS error FROM customer",
        ),
        "score_tables": (score_tables, "SELECT p_brand, round(avg(p_size), 4) AS p_size, round(avg(p_retailprice), 4) AS p_retailprice FROM part GROUP BY 1"),
    }
