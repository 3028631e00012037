"""Exact top-k search (operator 10): exhaustive term-at-a-time accumulation.

Rows are sparse vectors of whole numbers. Candidates are dealt into blocks, each
kept as an inverted index: for each term the candidates that have it and their
weights. For a query, the postings of its terms are scattered, weighted, into a
dense score array of the block, term after term; a partition selection takes
the block's k best, and the blocks' bests are merged. Query blocks meet
candidate blocks through a key of both, so that a task holds one of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Candidates and queries in a block, about, and the queries scored together.
CANDIDATES, QUERY_ROWS, TILE = 4096, 512, 16
PACKED = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("ends", pa.binary()), ("terms", pa.binary()), ("weights", pa.binary())])


def _packed(rows: DataFrame, n: int, kind: str) -> DataFrame:
    """Rows (id, terms, weights) as ``n`` blocks of flat arrays, ids ascending, weights of the NumPy type ``kind``."""

    def pack(t: pa.Table) -> pa.Table:
        ids, parts = t["id"].to_numpy(), [t[c].combine_chunks() for c in ("terms", "weights")]
        order = np.lexsort((t["key"].to_numpy(), ids))  # rows of one id in an order of their own, so that a task that runs again gives the same
        rows = [p.take(pa.array(order)) for p in parts]
        ends = np.cumsum([len(x) for x in rows[0]], dtype=np.int64)
        terms, weights = (r.flatten().to_numpy() for r in rows)
        return pa.Table.from_batches([common.batch(PACKED, [t["block"][0].as_py()], [ids[order].astype(np.int64).tobytes()], [ends.tobytes()], [terms.astype(np.int32).tobytes()], [weights.astype(kind).tobytes()])])

    dealt = rows.withColumn("key", F.xxhash64("terms", "weights")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return dealt.groupBy("block").applyInArrow(pack, "block int, ids binary, ends binary, terms binary, weights binary")


class BlockIndex:
    """The inverted index of one block of candidates."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.ids, n = ids, len(ids)
        rows = np.repeat(np.arange(n), np.diff(ends, prepend=0))
        order = np.argsort(terms, kind="stable")
        names, first = np.unique(terms[order], return_index=True)
        self.postings: dict[int, tuple[np.ndarray | None, np.ndarray]] = {}
        for t, i, j in zip(names.tolist(), first, [*first[1:], len(terms)], strict=True):
            who, w = rows[order[i:j]], weights[order[i:j]]
            if 4 * len(who) >= n:  # a posting that most candidates have is kept with its gaps as zeros
                dense = np.zeros(n, w.dtype)
                dense[who] = w
                self.postings[t] = (None, dense)
            else:
                self.postings[t] = (who, w)
        self._added = np.zeros((TILE, n), weights.dtype)

    def scores(self, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The inner products of at most TILE queries with all candidates, accumulated term after term."""
        n = len(ends)
        out, added = np.zeros((n, len(self.ids)), weights.dtype), self._added[:n]
        rows = np.repeat(np.arange(n), np.diff(ends, prepend=0))
        order = np.argsort(terms, kind="stable")
        names, first = np.unique(terms[order], return_index=True)
        for t, i, j in zip(names.tolist(), first, [*first[1:], len(terms)], strict=True):
            if posting := self.postings.get(t):
                who, values = posting
                mine = rows[order[i:j]]
                if who is None:
                    w = np.zeros((n, 1), weights.dtype)
                    w[mine, 0] = weights[order[i:j]]
                    np.multiply(w, values, out=added)
                    out += added
                else:
                    out[np.ix_(mine, who)] += np.multiply.outer(weights[order[i:j]], values)
        return out

    def best(self, queries: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places among the queries, query ids, ids and scores of the k best of each query but its own; equal scores by smaller id."""
        n, lowest = scores.shape[1], np.iinfo(scores.dtype).min
        for r, (i, j) in enumerate(zip(np.searchsorted(self.ids, queries, "left"), np.searchsorted(self.ids, queries, "right"), strict=True)):
            scores[r, i:j] = lowest
        least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(queries), lowest)
        out = []
        for r, s in enumerate(scores):
            at = np.flatnonzero(s >= max(least[r], lowest + 1))  # ids ascend
            if len(at) > k:
                at = np.sort(np.concatenate([at[s[at] > least[r]], at[s[at] == least[r]]])[:k])
            out.append((np.full(len(at), r), np.full(len(at), queries[r]), self.ids[at], s[at].astype(np.int64)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id and score of each query's ``k`` best candidates by inner product.

    Both sides hold id (long), terms (array of int) and weights (array of long),
    a row's terms without repeats and without zero weights; a row without terms
    scores 0. A candidate with the query's own id takes no part. Ties go to the
    smaller id; repeated ids stay as separate candidates. A query that occurs
    again is asked once; different rows of one id are queries of their own, each
    with its ranks. Queries and candidates
    meet block by block; an empty side gives no rows. Nulls are for the caller
    to leave out. Every pair is scored: no pruning, no approximation.
    """
    spark = candidates.sparkSession
    size = F.coalesce(F.max(F.aggregate("weights", F.lit(0).cast("long"), lambda a, w: a + F.abs(w))), F.lit(0))
    most_w = F.coalesce(F.max(F.array_max(F.transform("weights", F.abs))), F.lit(0))
    (n, most), (nq, wq) = candidates.agg(F.count("*"), size).first(), queries.agg(F.count("*"), most_w).first()
    blocks, query_blocks = max(1, math.ceil(n / CANDIDATES)), max(1, math.ceil(nq / QUERY_ROWS))
    kind = "int32" if int(most) * int(wq) < 2**31 - 2 else "int64"  # no sum can leave its bits

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("q_block", pa.int32()), ("q_row", pa.int32()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
        kinds = (np.int64, np.int64, np.int32, np.dtype(kind))
        at, index = None, None
        for b in batches:
            for row in b.to_pylist():
                ids, ends, terms, weights = (np.frombuffer(row[c], t) for c, t in zip(("ids", "ends", "terms", "weights"), kinds, strict=True))
                if row["block"] != at:
                    at, index = row["block"], BlockIndex(ids, ends, terms, weights)
                qids, qends, qterms, qweights = (np.frombuffer(row["q_" + c], t) for c, t in zip(("ids", "ends", "terms", "weights"), kinds, strict=True))
                for i in range(0, len(qids), TILE):
                    base, ends = (qends[i - 1] if i else 0), qends[i : i + TILE]
                    scores = index.scores(ends - base, qterms[base : ends[-1]], qweights[base : ends[-1]])
                    rows, *found = index.best(qids[i : i + TILE], scores, k)
                    yield common.batch(schema, np.full(len(rows), row["q_block"]), rows + i, *found)

    left = _packed(candidates.select("id", "terms", "weights"), blocks, kind)
    right = _packed(queries.select("id", "terms", "weights").distinct(), query_blocks, kind)
    right = right.select(F.col("block").alias("q_block"), *[F.col(c).alias("q_" + c) for c in ("ids", "ends", "terms", "weights")])
    # a stated query set against all rows, block by block
    pairs = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(left.hint("merge"), "block")
    met = pairs.repartition(min(blocks * query_blocks, 4096), "block", "q_block").sortWithinPartitions("block")
    found = met.mapInArrow(score, "q_block int, q_row int, query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def whole_vectors(rows: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """Sparse rows of ``floor(scale * x)`` for each component; vectors with nulls or non-finite components go.

    So do vectors whose scaled components come to 2 ** 31 or more together, taken
    without sign: their products with others like them need not fit into 64 bits.
    """
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    large = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v * scale) + 1) >= float(2**31)
    bad = bad | large
    cells = F.transform(x, lambda v, i: F.struct(i.cast("int").alias("t"), F.floor(v * scale).alias("w")))
    kept = F.filter(cells, lambda c: c["w"] != 0)
    return rows.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & ~bad).select(F.col(id_column).cast("long").alias("id"), kept.alias("c")).select("id", F.col("c.t").alias("terms"), F.col("c.w").alias("weights"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every vec_id divisible by 20."""
    rows = whole_vectors(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 64)
    return top_k(rows.where(F.col("id") % 20 == 0), rows, 20).withColumnRenamed("id", "vec_id")


QUERIES = {"op10_topk_search": op10_topk_search}
ORACLE_SQL = {
    "op10_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.w, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, w ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 20"""
}
