"""Toxicity (operator 8): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words of a text and their stems (the first letters of longer
words), its word pairs, and pairs with one word left out between them, each hashed into ``2 ** BITS`` coordinates and counted once.
Training follows the published per-coordinate update: each coordinate has its
own learning rate, and L1 keeps those without evidence at exactly zero, so that
the weights are few and their number is bounded by the coordinates. Scoring
passes over each whole text once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Coordinates, as a power of two. At most 2 ** BITS weights of 8 bytes are broadcast.
BITS = 20
#: Letters of a stem.
STEM = 5
#: Learning parameters: rate, its offset, L1, L2, passes, and the weight of a toxic document.
ALPHA, BETA, L1, L2, PASSES, TOXIC_WEIGHT = 1.0, 1.0, 4.0, 0.1, 5, 4.0
#: The documented bound of the sample that is learnt from: so many labelled documents, in order of a hash of their id.
TRAIN_ROWS = 16_000
#: From this score on a document counts as toxic.
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W_]+")


def features(text: str | None) -> np.ndarray:
    """The distinct coordinates of a whole text's word, pair and skip-pair features.

    Null, empty and wordless texts have none.
    """
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.int32)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], dtype=np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    stems = np.array([digest(w[:STEM]) for w in words if len(w) > STEM], dtype=np.uint64) + np.uint64(7)
    parts = [h, stems, (h[:-1] * odd) ^ h[1:], (h[:-2] * odd + np.uint64(1)) ^ (h[2:] * np.uint64(3))]
    every = np.concatenate(parts) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(every >> np.uint64(64 - BITS)).astype(np.int32)


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss over binary features."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias_z = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def _bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha + self.l2)

    def learn(self, x: np.ndarray, label: int, weight: float = 1.0) -> None:
        z, n = self.z[x], self.n[x]
        w, b = self._weights(z, n), self._bias()
        g = weight * (probability(b + w.sum()) - label)
        self.z[x] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[x] = n + g * g
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        """The coordinates with weights, the weights, and the bias."""
        w = self._weights(self.z, self.n)
        at = np.flatnonzero(w)
        return at.astype(np.int32), w[at].astype(np.float32), self._bias()


def probability(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(margin, -35, 35))))


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document are kept from training: crc32 of its id as text leaves 1 on division by 3; not without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of a bounded sample of labelled documents: coordinates, weights, bias.

    Of labels (doc_id, toxic) those that are not held out count; a document that
    any row calls toxic is toxic; null ids and labels are left out. The sample
    is the first ``rows`` ids by hash, so that it keeps the share of toxic
    documents; it is learnt by one task, in that order. Labels without a
    document are left out, and without any left the model is empty.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("turn", F.xxhash64("doc_id", F.lit(8)))
    sample = known.orderBy("turn", "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def learn(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["doc_id"].to_numpy(), t["turn"].to_numpy()))
        flat, ends = bytearray(), [0]  # one block of memory, which goes back as a whole
        for v in t["text"]:
            flat += features(v.as_py()).tobytes()
            ends.append(len(flat) // 4)
        x, y = np.frombuffer(flat, np.int32), t["toxic"].to_numpy()
        model = Ftrl()
        for _ in range(passes):
            for i in order:
                model.learn(x[ends[i] : ends[i + 1]], int(y[i] > 0), TOXIC_WEIGHT if y[i] > 0 else 1.0)
        at, w, bias = model.sparse()
        del flat, x, model
        common.release()
        return pa.table({"at": [at.tobytes()], "w": [w.tobytes()], "bias": [bias]}, schema=pa.schema([("at", pa.binary()), ("w", pa.binary()), ("bias", pa.float64())]))

    found = texts.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "at binary, w binary, bias double").collect()  # a row, of 8 bytes a coordinate at most
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0
    return np.frombuffer(found[0]["at"], np.int32), np.frombuffer(found[0]["w"], np.float32), found[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    The text alone is scored; null and empty texts get the model's bias. Columns
    of these two names are replaced. Repeated rows are scored alike; an empty
    table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")

    @common.tidied
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, w, bias = sent.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = w
        for texts in batches:
            yield pa.array([probability(bias + float(dense[features(t.as_py())].sum(dtype=np.float64))) for t in texts], pa.float64())

    scores = F.arrow_udf(scored, "double")
    return docs.withColumn("score", scores("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the labels that are not held out."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
