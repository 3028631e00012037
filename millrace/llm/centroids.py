"""Centroid clustering with adaptive bounds (operator 13).

Lloyd's rounds, exact to the last digit. Every vector keeps its nearest
centroids in order, a lower bound of the distance to each but the first, one
bound for all the rest, and an upper bound of the distance to its own centroid.
When centroids move, the bounds move with them; only the centroids whose order
the bounds cannot certify are measured again, up to all of them. Vectors lie in
blocks that carry their bounds with them, so a round moves no vectors: of each
block only the sums of its clusters are shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Vectors in a block at most, and centroids with a bound of their own.
ROWS, NEAREST = 4096, 6
#: Whole numbers below this are exact as doubles.
EXACT = 2.0**53
#: What a bound is widened by, relative to what it is made of: some units of the last place.
SLACK = 2.0**-49
#: The digits of sums on their way through a shuffle.
LIMB = 60
_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("kept", pa.binary()), ("bounds", pa.binary()), ("upper", pa.binary()), ("clusters", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("sums", pa.list_(pa.list_(pa.string())))])
_BLOCK_DDL = "ids array<bigint>, vectors binary, kept binary, bounds binary, upper binary, clusters array<int>, counts array<bigint>, sums array<array<string>>"


def _whole(x: np.ndarray) -> np.ndarray:
    """Doubles that hold whole numbers as Python's numbers, which have no bounds."""
    return np.frompyfunc(int, 1, 1)(x)


def squared(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` (whole numbers as doubles) to each centroid.

    They are doubles where all of them stay below EXACT; else rows or centroids
    with large components are computed with Python's numbers, and the result
    holds those.
    """
    c = np.array([[float(v) for v in row] for row in centroids]).reshape(len(centroids), x.shape[1])
    limit = math.sqrt(EXACT / (4 * max(1, x.shape[1])))
    small_x, small_c = (np.abs(x) < limit).all(axis=1), (np.abs(c) < limit).all(axis=1)
    near = lambda a, b: (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    if small_x.all() and small_c.all():
        return near(x, c)
    out = np.empty((len(x), len(c)), object)
    out[np.ix_(small_x, small_c)] = _whole(near(x[small_x], c[small_c]))
    for rows, at in ((~small_x, np.arange(len(c))), (small_x, np.flatnonzero(~small_c))):
        exact = _whole(x[rows])
        for j in at:
            if len(exact):
                d = exact - np.array(centroids[j], object)
                out[rows, j] = (d * d).sum(axis=1)
    return out


def _between(x: np.ndarray, centroids: list[list[int]], at: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to its own centroids, whose numbers are the rows of ``at``."""
    limit = math.sqrt(EXACT / (4 * max(1, x.shape[1])))
    top = max((abs(v) for row in centroids for v in row), default=0)
    if top < limit and (not x.size or np.abs(x).max() < limit):
        c = np.array(centroids, float)
        return np.stack([((x - c[at[:, j]]) ** 2).sum(axis=1) for j in range(at.shape[1])], axis=1)
    return np.take_along_axis(squared(x, centroids), at, axis=1)


def _root(d: np.ndarray, up: bool) -> np.ndarray:
    """Square roots, rounded so that they bound the true ones."""
    if d.dtype == object:
        top = 2**1000
        roots = np.array([math.isqrt(int(v)) + up for v in d.ravel()], object)
        r = np.array([math.inf if v > top and up else float(min(v, top)) for v in roots]).reshape(d.shape)
    else:
        r = np.sqrt(d)
    return r * (1 + SLACK) if up else r * (1 - SLACK)


def _ordered(d: np.ndarray) -> np.ndarray:
    """Columns of each row by distance, equal ones in their order."""
    return np.argsort(d, axis=1, kind="stable")


class Bounds:
    """The state of a block of vectors: ``kept`` (numbers of the nearest centroids, the own one first), ``lower`` (bounds of all but the first, and of the rest) and ``upper``."""

    def __init__(self, kept: np.ndarray, lower: np.ndarray, upper: np.ndarray):
        self.kept, self.lower, self.upper = kept, lower, upper

    @classmethod
    def first(cls, x: np.ndarray, centroids: list[list[int]]) -> Bounds:
        """All centroids measured."""
        b = min(NEAREST, len(centroids))
        made = cls(np.zeros((len(x), b), np.int32), np.zeros((len(x), b)), np.zeros(len(x)))
        made._scan(x, centroids, np.arange(len(x)))
        return made

    def _scan(self, x: np.ndarray, centroids: list[list[int]], rows: np.ndarray) -> None:
        b = self.kept.shape[1]
        d = squared(x[rows], centroids)
        order = _ordered(d)
        near = np.take_along_axis(d, order[:, : b + 1], axis=1)
        self.kept[rows] = order[:, :b]
        self.upper[rows] = _root(near[:, 0], True)
        low = _root(near[:, 1:], False)
        self.lower[rows] = low if low.shape[1] == b else np.pad(low, ((0, 0), (0, b - low.shape[1])), constant_values=np.inf)

    def moved(self, steps: np.ndarray) -> None:
        """Widen the bounds after centroids have moved by at most ``steps``."""
        self.upper = (self.upper + steps[self.kept[:, 0]]) * (1 + SLACK)
        b = self.kept.shape[1]
        away = np.empty_like(self.lower)
        away[:, : b - 1] = steps[self.kept[:, 1:]]
        away[:, b - 1] = steps.max(initial=0)
        with np.errstate(invalid="ignore"):
            self.lower = np.nan_to_num(self.lower * (1 - SLACK) - away * (1 + SLACK), nan=-np.inf, posinf=np.inf, neginf=-np.inf)

    def assign(self, x: np.ndarray, centroids: list[list[int]]) -> int:
        """Make the first of ``kept`` the nearest centroid again, equal ones by number. Returns how many distances were measured.

        Places from the first whose bound, and all later ones, lie above the
        upper bound are certain to hold no nearer or equally near centroid.
        """
        b = self.kept.shape[1]
        certain = np.minimum.accumulate(self.lower[:, ::-1], axis=1)[:, ::-1]  # [z]: of place z + 1 and all after it
        unsure = (self.upper[:, None] >= certain).sum(axis=1)  # certain[z] ascends with z
        measured = 0
        for m in np.unique(unsure):
            rows = np.flatnonzero(unsure == m)
            if m == 0:
                continue
            if m == b:
                self._scan(x, centroids, rows)
                measured += len(rows) * len(centroids)
                continue
            at = np.sort(self.kept[rows, : m + 1], axis=1)
            d = _between(x[rows], centroids, at)
            measured += d.size
            order = _ordered(d)
            near = np.take_along_axis(d, order, axis=1)
            self.kept[rows, : m + 1] = np.take_along_axis(at, order, axis=1)
            self.upper[rows] = _root(near[:, 0], True)
            self.lower[rows, :m] = _root(near[:, 1:], False)
        return measured


def _sums(x: np.ndarray, own: np.ndarray) -> tuple[list, list, list]:
    """Of each cluster of a block its number, the count of its vectors and their componentwise sums, as decimal text."""
    order = np.argsort(own, kind="stable")
    names, first = np.unique(own[order], return_index=True)
    exact = bool(x.size) and np.abs(x).max() * len(x) < EXACT
    sums = []
    for i, j in zip(first, [*first[1:], len(own)], strict=True):
        part = x[order[i:j]]
        sums.append([str(int(v)) for v in (part.sum(axis=0) if exact else _whole(part).sum(axis=0))])
    return names.tolist(), np.diff([*first, len(own)]).tolist(), sums


def _batch(ids: pa.Array, x: np.ndarray, state: Bounds | None) -> pa.RecordBatch:
    kept, lower, upper = (b"", b"", b"") if state is None else (state.kept.tobytes(), state.lower.tobytes(), state.upper.tobytes())
    clusters, counts, sums = ([], [], []) if state is None else _sums(x, state.kept[:, 0])
    return common.batch(_BLOCK, pa.array([ids.to_pylist()], _BLOCK.field("ids").type), [x.astype("<f8").tobytes()], [kept], [lower], [upper], [clusters], [counts], [sums])


def _read(row: dict, dims: int) -> tuple[np.ndarray, Bounds | None]:
    n = len(row["ids"])
    x = np.frombuffer(row["vectors"], "<f8").reshape(n, dims)
    if not row["upper"]:
        return x, None
    return x, Bounds(np.frombuffer(row["kept"], np.int32).reshape(n, -1).copy(), np.frombuffer(row["bounds"]).reshape(n, -1).copy(), np.frombuffer(row["upper"]).copy())


def scaled(rows: DataFrame, id_column: str, vector: str, dims: int, scale: int) -> DataFrame:
    """id and x: ``floor(scale * component)`` of the vectors of exactly ``dims`` components that are all there and finite."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: v * F.lit(float(scale)))
    fine = (F.size(vector) == dims) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector), x.alias("x")).where(F.col(vector).isNotNull() & fine).select("id", "x")


def _blocks(vectors: DataFrame) -> DataFrame:
    """Vectors in blocks of at most ROWS, without bounds yet. Each task makes its own; nothing is shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                x = np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(part.num_rows, -1)
                yield _batch(part.column(0), x, None)

    return vectors.mapInArrow(common.tidied(pack), _BLOCK_DDL)


def _round(blocks: DataFrame, dims: int, centroids: list[list[int]], before: list[list[int]] | None) -> DataFrame:
    """Every vector with its nearest centroid; ``before`` are the centroids of the round before."""
    steps = None
    if before is not None:
        steps = np.array([_root(squared(np.array([a], float), [c]), True)[0, 0] if max(map(abs, [*a, *c]), default=0) < EXACT else _far(a, c) for a, c in zip(before, centroids, strict=True)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                x, state = _read(row, dims)
                if state is None:
                    state = Bounds.first(x, centroids)
                else:
                    state.moved(steps)
                    state.assign(x, centroids)
                yield _batch(pa.array(row["ids"], pa.int64()), x, state)

    return blocks.mapInArrow(common.tidied(work), _BLOCK_DDL)


def _far(a: list[int], c: list[int]) -> float:
    """An upper bound of the distance of two centroids with components beyond exact doubles."""
    root = math.isqrt(sum((v - w) ** 2 for v, w in zip(a, c, strict=True))) + 1
    return math.inf if root > 2**1000 else float(root) * (1 + SLACK)


def _means(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The exact means of the clusters, rounded down; empty ones stay.

    Sums go through the shuffle in limbs of LIMB bits, so that none can
    overflow. What comes to the driver is one row for each component of a
    centroid and limb: it does not grow with the data.
    """

    @F.pandas_udf("array<struct<limb int, value long>>")
    def limbs(text):
        def cut(s: str) -> list[tuple[int, int]]:
            v, out, sign = abs(int(s)), [], -1 if s.startswith("-") else 1
            while v or not out:
                out.append((len(out), sign * (v & (1 << LIMB) - 1)))
                v >>= LIMB
            return out

        return text.map(cut)

    each = blocks.select(F.explode(F.arrays_zip("clusters", "counts", "sums")).alias("c")).select("c.clusters", "c.counts", F.posexplode("c.sums").alias("at", "sum"))
    wide = each.select("clusters", "at", "counts", F.explode(limbs("sum")).alias("l")).select("clusters", "at", F.when(F.col("l.limb") == 0, F.col("counts")).alias("n"), "l.limb", F.col("l.value").cast("decimal(38,0)").alias("value"))
    total = wide.groupBy("clusters", "at", "limb").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    sums: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    for r in total.collect():
        sums[r["clusters"], r["at"]] = sums.get((r["clusters"], r["at"]), 0) + (int(r["value"]) << LIMB * r["limb"])
        counts[r["clusters"]] = max(counts.get(r["clusters"], 0), r["n"] or 0)
    return [[sums[j, i] // counts[j] for i in range(len(c))] if j in counts else c for j, c in enumerate(centroids)]


def starts(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of salt and id, or all where there are fewer. Equal ids go by their components; null ids come last."""
    name = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    found = vectors.select(name.alias("name"), "x").orderBy(F.asc_nulls_last("name"), "x").limit(k).collect()
    return [[int(math.floor(v)) for v in r["x"]] for r in found]


def cluster(vectors: DataFrame, dims: int, k: int, rounds: int, salt: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector.

    ``vectors`` holds id (long) and x (array of ``dims`` doubles, of which the
    whole part downwards counts), as ``scaled`` makes them. Centroids are whole
    numbers; distances are exact for any finite doubles. Ties go to the smaller
    number. Repeated ids are vectors of their own; a null id is kept. With fewer
    than ``k`` vectors there are as many centroids, with none no rows. A
    distance or sum beyond 64 bits is null. Other columns play no part.
    """
    spark = vectors.sparkSession
    centroids, before = starts(vectors, k, salt), None
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    with common.Scratch(spark) as tmp:
        blocks = tmp.keep(_blocks(vectors), "blocks")
        for turn in range(rounds):
            held = tmp.keep(_round(blocks, dims, centroids, before), f"round{turn}")
            tmp.drop("blocks" if turn == 0 else f"round{turn - 1}")
            blocks, before = held, centroids
            centroids = _means(blocks, centroids)
        found = common.written(_measured(_round(blocks, dims, centroids, before), dims, centroids), "clusters")
    return _with_sums(found, centroids)


def _measured(blocks: DataFrame, dims: int, centroids: list[list[int]]) -> DataFrame:
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                x, state = _read(row, dims)
                d = [int(v) for v in _between(x, centroids, state.kept[:, :1])[:, 0]]
                yield common.batch(schema, row["ids"], state.kept[:, 0], [v if v < 2**63 else None for v in d])

    return blocks.mapInArrow(work, "vec_id long, cluster int, distance long")


def _with_sums(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Rows with the sums of their cluster, which are as many rows as centroids, and so broadcast."""
    spark = found.sparkSession
    exact = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    per = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(exact.alias("d")).collect()}
    whole = sum(per.values()) if None not in per.values() else None
    fit = lambda v: int(v) if v is not None and v < 2**63 else None
    rows = [(j, fit(per.get(j)), fit(whole), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    sums = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components, scaled by 256, in 40 clusters after 5 rounds."""
    rows = scaled(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 64, 256)
    return cluster(rows, 64, 40, 5, "2:")


def _sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds as a chain of tables; products of whole numbers are exact as doubles."""
    out = [f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS c, x FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k})"""]
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := d, c := c)) AS b FROM (
    SELECT v.r, c.c, list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x) AS d FROM v CROSS JOIN c{i} c) GROUP BY r)""")
        if i < rounds:
            out.append(f"""m{i} AS MATERIALIZED (
  SELECT c, list(m ORDER BY i) AS x FROM (
    SELECT a.b.c AS c, i, floor(sum(v.x[i]) / count(*)) AS m FROM v JOIN a{i} a USING (r), range(1, 65) t(i) GROUP BY 1, 2) GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))""")
    return ",\n".join(out) + f"""
SELECT vec_id, a.b.c AS cluster, CAST(a.b.d AS BIGINT) AS distance, CAST(sum(CAST(a.b.d AS BIGINT)) OVER (PARTITION BY a.b.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(CAST(a.b.d AS BIGINT)) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.x, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.c = a.b.c"""


QUERIES = {"op13_centroid_clustering": op13_centroid_clustering}
ORACLE_SQL = {"op13_centroid_clustering": _sql()}
