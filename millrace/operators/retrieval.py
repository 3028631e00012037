"""The retrieval pipeline: split, nearest neighbours, vote, prompts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.values import quoted

#: Queries, and rows of the pool, that meet in one task.
QUERY_BLOCK, POOL_BLOCK = 16_384, 16_384
#: Queries of a block that are scored at once.
TILE = 128


def stratified_split(rows: DataFrame, strata: str, key: str = "id", fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """``rows`` with ``held_out``: exactly the rounded-up fraction of all, shared out over the strata by largest remainder.

    Which rows of a stratum are held out follows from a hash of key and seed: those
    up to a bound. Counts of ranges of the hash tell in which range the bound lies,
    and only the rows of that range are ranked, so no stratum is sorted whole. The
    strata's sizes, one row each, decide the quotas; a null stratum is one. Rows of
    the same key share a side, so with repeated keys a stratum may exceed its quota.
    """
    hashed = F.xxhash64(F.col(quoted(key)), F.lit(seed))
    keyed = rows.select(F.col(quoted(strata)).alias("__s"), F.col(quoted(key)).alias("__k"), hashed.alias("__h"), F.shiftright(hashed, 50).alias("__range"))
    ranges = keyed.groupBy("__s", "__range").agg(F.count(F.lit(1)).alias("__in"))
    sizes = ranges.groupBy("__s").agg(F.sum("__in").alias("__n"))
    # a total over the strata alone; ties of remainders go by size, then name
    total = sizes.agg(F.ceil(F.round(F.sum("__n") * fraction, 6)).alias("__want"), F.sum(F.floor(F.col("__n") * fraction)).alias("__have"))
    want, have = total.first() or (0, 0)
    rest = int((want or 0) - (have or 0))
    turn = F.row_number().over(Window.orderBy(F.desc(F.col("__n") * fraction - F.floor(F.col("__n") * fraction)), F.desc("__n"), F.col("__s").asc_nulls_first()))
    quotas = sizes.select(F.col("__s").alias("__t"), (F.floor(F.col("__n") * fraction) + (turn <= rest).cast("int")).alias("__quota"))
    upto = ranges.withColumn("__upto", F.sum("__in").over(Window.partitionBy("__s").orderBy("__range")))
    left = F.col("__quota") - F.col("__upto") + F.col("__in")  # of the range that has the bound
    cuts = upto.join(quotas, F.col("__s").eqNullSafe(F.col("__t"))).where((left > 0) & (left <= F.col("__in"))).select("__t", F.col("__range").alias("__cut"), left.alias("__left"))
    near = keyed.join(cuts, F.col("__s").eqNullSafe(F.col("__t")) & (F.col("__range") == F.col("__cut")))
    place = F.row_number().over(Window.partitionBy("__s").orderBy("__h", "__k"))
    bounds = near.withColumn("__place", place).where(F.col("__place") == F.col("__left")).select("__t", F.struct(F.col("__h").alias("h"), F.col("__k").alias("k")).alias("__bound"))
    mine = F.struct(hashed.alias("h"), F.col(quoted(key)).alias("k"))
    both = rows.join(bounds, F.col(quoted(strata)).eqNullSafe(F.col("__t")), "left")
    return both.withColumn("held_out", F.coalesce(mine <= F.col("__bound"), F.lit(False))).drop("__t", "__bound")


def leaks(split: DataFrame, key: str = "id") -> DataFrame:
    """overlap (ids in both halves), and duplicates in the pool and among the held-out rows."""
    per = split.groupBy(key).agg(F.count_if(F.col("held_out")).alias("t"), F.count_if(~F.col("held_out")).alias("p"))
    return per.agg(F.count_if((F.col("t") > 0) & (F.col("p") > 0)).alias("overlap"), F.count_if(F.col("p") > 1).alias("pool_duplicates"), F.count_if(F.col("t") > 1).alias("test_duplicates"))


def neighbours(queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, label and score: the ``k`` nearest of the pool by cosine, exactly; ties by id.

    ``queries`` holds id and vector, ``pool`` id, vector and label. Blocks of both
    meet in the cluster, each in a task that keeps a query's k best of the block;
    those are merged. Fewer than k in the pool give fewer rows. Vectors that are
    null, zero or hold a null, a NaN or an infinity take no part; those of
    another length than the query's are no neighbours of it.
    """
    vector = F.col("vector").cast("array<double>").alias("vector")
    whole = F.col("vector").isNotNull() & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    asked, offered = (df.select("id", vector, *more).where(whole).withColumn("length", F.size("vector")) for df, more in ((queries, []), (pool, ["label"])))
    blocks, parts = (max(1, -(-df.count() // size)) for df, size in ((asked, QUERY_BLOCK), (offered, POOL_BLOCK)))
    dealt = lambda n: F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", dealt(blocks)).withColumn("part", every(parts)).withColumnRenamed("id", "query_id")
    right = offered.withColumn("part", dealt(parts)).withColumn("block", every(blocks)).withColumn("pooled", F.lit(True))
    both = left.unionByName(right, allowMissingColumns=True).groupBy("block", "part", "length")
    kinds = [queries.schema["id"].dataType, pool.schema["id"].dataType, pool.schema["label"].dataType, T.DoubleType()]
    made = T.StructType([T.StructField(n, kind) for n, kind in zip(("query_id", "id", "label", "score"), kinds, strict=True)])
    found = both.applyInArrow(_nearest(k, to_arrow_schema(made)), made)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "label", "score")


def _unit(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows whose vectors have a direction, without them, and the vectors at unit length."""
    v = pc.list_flatten(rows["vector"]).to_numpy().astype(np.float64).reshape(len(rows), -1)
    rows = rows.drop_columns("vector")
    size = np.linalg.norm(v, axis=1)
    if not (size > 0).all():
        rows, v, size = rows.filter(pa.array(size > 0)), v[size > 0], size[size > 0]
    v = v if v.flags.writeable else v.copy()
    v /= size[:, None]
    return rows, v


def _nearest(k: int, schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    def run(both: pa.Table) -> pa.Table:
        asked, offered = both.filter(pc.is_null(both["pooled"])).select(["query_id", "vector"]), both.filter(pc.is_valid(both["pooled"])).select(["id", "label", "vector"])
        if not len(asked) or not len(offered):
            return schema.empty_table()
        asked, q = _unit(asked)
        offered, v = _unit(offered.sort_by("id"))
        whose, which, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        n = len(offered)
        for i in range(0, len(asked) if n else 0, TILE):
            tile = np.round(q[i : i + TILE] @ v.T, 12)  # sums in another order are still ties
            least = np.partition(tile, n - k, axis=1)[:, n - k] if n > k else np.full(len(tile), -np.inf)
            for r, s in enumerate(tile):
                at = np.flatnonzero(s >= least[r])  # ids ascend
                at = at[np.argsort(-s[at], kind="stable")][:k]
                whose.append(np.full(len(at), i + r))
                which.append(at)
                scores.append(s[at])
        near = offered.take(pa.array(np.concatenate(which)))
        return pa.table({"query_id": asked["query_id"].take(pa.array(np.concatenate(whose))), "id": near["id"], "label": near["label"], "score": np.concatenate(scores)})

    return run


def vote(near: DataFrame, k: int) -> DataFrame:
    """query_id and predicted: the most common label of the k nearest; on any tie for it that of the nearest."""
    counts = near.where(F.col("rank") <= k).groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    per = counts.groupBy("query_id").agg(F.max("n").alias("most"), F.collect_list(F.struct("n", "label")).alias("all"), F.min_by("label", "first").alias("nearest"))
    top = F.filter("all", lambda x: x["n"] == F.col("most"))
    return per.select("query_id", F.when(F.size(top) == 1, top[0]["label"]).otherwise(F.col("nearest")).alias("predicted"))


def vote_sweep(near: DataFrame, ks: list[int]) -> DataFrame:
    """query_id, k and predicted for several k of one search."""
    wide = near.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))
    keyed = wide.withColumn("query_id", F.struct("query_id", "k"))
    return vote(keyed, max(ks)).select("query_id.query_id", "query_id.k", "predicted")


def accuracy(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """matches, n and accuracy of predictions against truth (query_id, label)."""
    both = predicted.join(truth.select("query_id", F.col("label").alias("__truth")), "query_id")
    hit = F.col("predicted").eqNullSafe(F.col("__truth"))
    return both.agg(F.count_if(hit).alias("matches"), F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("int")), 4).alias("accuracy"))


def embed(rows: DataFrame, column: str, model: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``rows`` with ``vector``: ``model`` gives token states and mask of a batch; masked mean, then unit length."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        states, mask = model(texts.fillna("").tolist())
        return pd.Series(list(mean_pool(states, mask)))

    return rows.withColumn("vector", run(column))


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of unmasked token states, scaled to unit length."""
    m = mask[..., None].astype(np.float64)
    pooled = (states * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)
    return (pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def generate(prompts: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """``prompts`` (id, system_prompt, ...) with generated_query, error and latency_s of a pluggable model."""
    import time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for p in pdf["system_prompt"]:
                began = time.time()
                try:
                    made.append((model(p), None, round(time.time() - began, 3)))
                except Exception as e:  # noqa: BLE001  an error is the row's result
                    made.append((None, str(e), round(time.time() - began, 3)))
            yield pdf.assign(generated_query=[m[0] for m in made], error=[m[1] for m in made], latency_s=[m[2] for m in made])

    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(run, f"{schema}, generated_query string, error string, latency_s double")


#: The wording of prompts: of the schema block's head, of the examples' head, and of one example. Callers may give their own.
WORDING = {
    "schema": "Schema of {database}, {n} collection(s):\n",
    "examples": "The {n} most similar questions asked before, with their queries:\n\n",
    "example": "{rank}. Question: {question}\nQuery: {query}\n",
}


def _worded(text: str, **parts: Column) -> Column:
    """A text with columns in place of its {names}."""
    pieces = [F.lit(p) if i % 2 == 0 else F.coalesce(parts[p].cast("string"), F.lit("None")) for i, p in enumerate(re.split(r"\{(\w+)\}", text))]
    return F.concat(*pieces)


def schema_block(cards: DataFrame, wording: dict[str, str] = WORDING) -> DataFrame:
    """database and its rendered schema, collections in order of name."""
    line = F.concat(F.lit("- "), "collection", F.lit(": { "), F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit(" ("), f["type"], F.lit(")"))), ", "), F.lit(" }"))
    per = cards.groupBy("database").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("collection", line.alias("line")))).alias("lines"))
    head = _worded(wording["schema"], database=F.col("database"), n=F.col("n"))
    return per.select("database", F.concat_ws("\n", head, F.transform("lines", lambda x: x["line"])).alias("schema_block"))


def numeric_note(cards: DataFrame, fields: dict[str, list[str]], text: str) -> dict[str, str]:
    """For each database of ``fields``, the ``text`` with {fields} in the place of its numeric-string fields, as collection.field.

    Of the fields (collection.field) those are named that the database's cards have, in the given order; a database without any has no note.
    """
    known = {(r["database"], f"{r['collection']}.{f['name']}") for r in cards.where(F.col("database").isin(list(fields))).collect() for f in r["fields"]}
    named = {d: [f for f in wanted if (d, f) in known] for d, wanted in fields.items()}
    return {d: text.replace("{fields}", ", ".join(found)) for d, found in named.items() if found}


def prompts(cases: DataFrame, near: DataFrame, pool: DataFrame, cards: DataFrame, header: str, rules: str, notes: dict[str, str] | None = None, k: int = 10, wording: dict[str, str] = WORDING) -> DataFrame:
    """A prompt row for each case (id, question, database, complexity).

    ``near`` is what neighbours() gives with the database as label, ``pool`` has
    id, question and normalized_query. ``notes`` are texts by database, a few,
    as numeric_note() makes them. All sentences are the caller's: ``header``,
    ``rules``, ``notes`` and ``wording``.
    """
    voted = vote(near, k).withColumnRenamed("predicted", "predicted_database")
    shown = near.where(F.col("rank") <= k).join(pool.select("id", F.col("question").alias("q"), "normalized_query"), "id")
    listed = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "label", "q", "normalized_query"))).alias("ex"))
    one = F.transform("ex", lambda e: _worded(wording["example"], rank=e["rank"], question=e["q"], query=e["normalized_query"]))
    examples = F.concat(_worded(wording["examples"], n=F.size("ex")), F.array_join(one, "\n"))
    note = F.lit("")
    for database, text in (notes or {}).items():
        note = F.when(F.col("predicted_database") == database, F.lit(text)).otherwise(note)
    rows = cases.withColumnRenamed("id", "query_id").join(voted, "query_id").join(listed, "query_id").join(schema_block(cards, wording).withColumnRenamed("database", "predicted_database"), "predicted_database", "left")
    empty = _worded(wording["schema"], database=F.col("predicted_database"), n=F.lit(0))
    text = F.concat(F.lit(header), examples, F.lit("\n"), F.coalesce("schema_block", empty), note, F.lit("\n" + rules))
    return rows.select(
        F.col("query_id").alias("id"), "question", F.col("database").alias("gold_database"), "predicted_database",
        F.col("predicted_database").eqNullSafe(F.col("database")).alias("database_match"),
        F.transform("ex", lambda e: e["id"]).alias("retrieved_ids"), F.transform("ex", lambda e: e["label"]).alias("retrieved_neighbor_databases"),
        "complexity", text.alias("system_prompt"),
    )
