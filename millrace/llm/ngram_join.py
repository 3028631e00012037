"""N-gram Jaccard join (operator 4) by vertical partitioning.

The global order of the word n-grams is that of their 64-bit hashes. It is cut
into fragments, and a document's set falls into one segment per fragment.

1. Candidates. Two sets of at most ``hi`` n-grams that reach the threshold differ
   in at most ``d`` of them, so with ``d`` + 1 + s fragments at least s + 1
   segments are the same in both. A segment's signature is a key under which
   documents meet. Empty segments say nothing: a document that has at most s of
   them leaves them out, since one of the common segments must then hold
   n-grams; a document with more of them keeps them as keys. Sizes fall into
   classes, each with its own ``hi``; a set takes part in its own class and, as
   the smaller partner, in the next. Of a set with e empty segments s + 1 - e keys
   are common with any partner, so in the order of how many documents meet under
   them its s - e most frequent keys of a class may go: the rarest common key of
   two sets is among what both keep. That empties the meetings under passages
   that many documents share. Of keys under which the same documents meet one is
   enough; it weighs as much as all of them.
2. Copies. Documents with equal sets are one class and the class one candidate.
3. Hubs. In each meeting under a key, one document is the hub, and each document
   is paired with the hub that it shares the most keys with: at most as many pairs
   as documents. Short digests of finer segments bound the difference of a pair
   from below; of pairs that they do not rule out the overlap is counted segment
   by segment and summed per pair. A second round takes its hubs from what the
   smallest component of a meeting left over.
4. The rest. Documents that meet under a key and are still in different
   components are compared block against block by their digests: first by coarse
   ones, which leave out documents without a possible partner, then by finer
   ones. What is not ruled out is counted as in 3. No pair is left out, none is
   listed within a component.

Keys are dealt into parts by their bits. Meetings are found (1) and fine digests
compared (4) for one part after the other, and a part's shuffles are freed before
the next, so that the disk does not hold those of all keys at once.

Components are found by hooking and pointer jumping over tables in the shared
folder. Nothing is collected; the driver sees counts.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Segments in which verified overlaps are counted.
SEGMENTS = 4
#: Rows of one side of a block in step 4, and the largest number of digests of one document.
BLOCK, DIGESTS = 1024, 2048
#: Bits of a key that hold its size class.
LEVEL_BITS = 9
#: Parts of the keys that follow each other, where meetings are found and where fine digests are compared.
PARTS, FINE_PARTS = 4, 2
#: Ids (8 bytes each) that may be broadcast; beyond it tables are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """The distinct hashes, ascending, of a text's ``k``-word shingles.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of
    fewer words, but not none, is one shingle; no words give an empty array.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], dtype=np.uint64)
    n = max(1, len(h) - k + 1)
    take = min(k, len(h))
    out = np.full(n, take, np.uint64)
    for j in range(take):
        out = _mix(out + h[j : j + n])
    return np.unique(out)


def _share(per_cent: int, both: int) -> int:
    """The largest difference of two sets of ``both`` n-grams together that are ``per_cent`` similar."""
    return (100 - per_cent) * both // (100 + per_cent)


@lru_cache(maxsize=8)
def _classes(per_cent: int) -> tuple[list[int], list[int], list[int]]:
    """Of each size class: its largest size, its number of fragments, and how many empty segments say nothing."""
    his, parts, spare = [1], [], []
    while his[-1] < 1 << 40:
        his.append(max(his[-1] + 1, his[-1] * 100 // per_cent))
    for hi in his:
        d = _share(per_cent, 2 * hi)
        empty = (d + 1) * math.exp(-hi * per_cent / 100 / (d + 1))
        s = math.ceil(empty + 3 * math.sqrt(empty)) if d else 0
        parts.append(d + 1 + s)
        spare.append(s)
    return his, parts, spare


def _levels(n: int, per_cent: int) -> list[int]:
    """The size classes in which a set of ``n`` n-grams takes part."""
    his, _, _ = _classes(per_cent)
    own = bisect_left(his, n)
    return [own] + [own + 1] * (100 * n >= per_cent * (his[own] + 1))


def _cut(h: np.ndarray, m: int) -> np.ndarray:
    """Where the ``m`` segments of ascending hashes end, from 0 on."""
    at = np.arange(m, dtype=np.uint64) * np.uint64(-(-(1 << 64) // m) if m > 1 else 0)
    return np.append(np.searchsorted(h, at), len(h))


_SUMS_SEED = np.uint64(0x9E3779B97F4A7C15)


def _segment_sums(h: np.ndarray, m: int) -> np.ndarray:
    """A 64-bit signature of each of ``m`` segments; 0 for an empty one."""
    ends = _cut(h, m)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(_mix(h ^ _SUMS_SEED), out=sums[1:])
    return sums[ends[1:]] - sums[ends[:-1]]


def signatures(h: np.ndarray, per_cent: int) -> np.ndarray:
    """The keys under which a set meets every other that may be similar enough. The low bits tell the size class."""
    return _keys(h, per_cent)[0]


def _keys(h: np.ndarray, per_cent: int) -> tuple[np.ndarray, list[int]]:
    """A set's keys, and for each of its size classes how many of them it can do without."""
    out, over = [], []
    _, parts, spare = _classes(per_cent)
    for level in _levels(len(h), per_cent):
        m = parts[level]
        sums = _segment_sums(h, m)
        which = np.arange(m, dtype=np.uint64)
        full = sums != 0
        empty = m - int(np.count_nonzero(full))
        over.append(max(0, spare[level] - empty))
        if empty <= spare[level]:
            sums, which = sums[full], which[full]
        low = np.uint64(LEVEL_BITS)
        out.append(_mix(_mix(sums) + which) >> low << low | np.uint64(level))
    return np.concatenate(out), over


def digests(h: np.ndarray, level: int, per_cent: int) -> bytes:
    """One byte for each of the finer segments of a set in a size class."""
    m = min(DIGESTS, 8 * _classes(per_cent)[1][level])
    return _segment_sums(h, m).astype(np.uint8).tobytes()


def _coarse(fine: bytes) -> bytes:
    """The digests of four finer segments each as one; they add up."""
    return np.frombuffer(fine, np.uint8).reshape(-1, 4).sum(axis=1).astype(np.uint8).tobytes()


def _possible(differ, n, m, per_cent: int):
    """Whether sets of n and m n-grams, at least ``differ`` of them in one alone, may be similar enough; numbers or arrays."""
    return (100 * np.minimum(n, m) >= per_cent * np.maximum(n, m)) & (differ <= (100 - per_cent) * (n + m) // (100 + per_cent))


def _sets(docs: DataFrame, k: int, per_cent: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if it is empty or has no id), the first size class, what each class can do without, and keys by part."""
    parts = [f"keys_{p}" for p in range(PARTS)]
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("level", pa.int32()), ("over", pa.list_(pa.int32())), *((p, pa.list_(pa.int64())) for p in parts)])

    def dealt(keys: list[np.ndarray]) -> Iterator[pa.Array]:
        flat, of = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        part = (flat >> np.uint64(LEVEL_BITS)) % np.uint64(PARTS)
        for p in range(PARTS):
            ends = np.cumsum([0, *np.bincount(of[part == p], minlength=len(keys))]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[part == p].astype(np.int64)))

    @common.tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part, sizes, names, keys, levels, overs = b.slice(i, 1000), [], [], [], [], []
                for doc_id, text in zip(part.column(0), part.column(1), strict=True):
                    h = shingle_hashes(text.as_py(), k)
                    sizes.append(len(h))
                    linked = len(h) and doc_id.is_valid
                    names.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if linked else None)
                    own, over = _keys(h, per_cent) if linked else (np.zeros(0, np.uint64), [])
                    keys.append(own)
                    overs.append(over)
                    levels.append(_levels(len(h), per_cent)[0] if linked else None)
                yield common.batch(schema, part.column(0), sizes, names, levels, overs, *dealt(keys))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n_shingles long, digest binary, level int, over array<int>" + "".join(f", {p} array<long>" for p in parts))


def _with_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is in ``ids`` (one column of the same name, without repeats)."""
    small = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, column, "left_semi")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents ``ids`` (id, without repeats)."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_ids(named, ids.withColumnRenamed("id", "doc_id"), "doc_id")


def _segments(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id, fragment and n-gram hashes (ascending, 8 bytes each) of the documents ``ids``."""
    schema = pa.schema([("id", pa.int64()), ("fragment", pa.int32()), ("grams", pa.binary())])

    @common.tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part, rows = b.slice(i, 500), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    h = shingle_hashes(text.as_py(), k)
                    ends = _cut(h, SEGMENTS)
                    rows += [(doc_id, f, h[ends[f] : ends[f + 1]].tobytes()) for f in range(SEGMENTS)]
                yield common.batch(schema, *zip(*rows, strict=True))

    return _texts(docs, ids).mapInArrow(work, "id long, fragment int, grams binary").dropDuplicates(["id", "fragment"])


def _digest_rows(docs: DataFrame, ids: DataFrame, k: int, per_cent: int) -> DataFrame:
    """id, level, n, and coarse and fine digests of the documents ``ids``, for each of their size classes."""
    schema = pa.schema([("id", pa.int64()), ("level", pa.int32()), ("n", pa.int64()), ("coarse", pa.binary()), ("fine", pa.binary())])

    @common.tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part, rows = b.slice(i, 500), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    h = shingle_hashes(text.as_py(), k)
                    for level in _levels(len(h), per_cent):
                        d = digests(h, level, per_cent)
                        rows.append((doc_id, level, len(h), _coarse(d), d))
                yield common.batch(schema, *zip(*rows, strict=True))

    return _texts(docs, ids).mapInArrow(work, "id long, level int, n long, coarse binary, fine binary").dropDuplicates(["id", "level"])


def _not_ruled_out(pairs: DataFrame, marks: DataFrame, per_cent: int) -> DataFrame:
    """Those of the pairs (a, b, level) that digests leave possible, as (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @common.tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
            differ = np.array([np.count_nonzero(_bytes(x) != _bytes(y)) for x, y in zip(batch.column(4), batch.column(5), strict=True)], dtype=np.int64)
            keep = _possible(differ, n, m, per_cent)
            yield common.batch(schema, a[keep], b[keep])

    left = marks.select(F.col("id").alias("a"), "level", F.col("n").alias("na"), F.col("fine").alias("fa"))
    right = marks.select(F.col("id").alias("b"), "level", F.col("n").alias("nb"), F.col("fine").alias("fb"))
    both = pairs.join(left, ["a", "level"]).join(right, ["b", "level"]).select("a", "b", "na", "nb", "fa", "fb")
    return both.mapInArrow(work, "a long, b long").distinct()


def _bytes(value: pa.Scalar, of: type = np.uint8) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), of)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two ascending arrays without repeats have in common."""
    if not len(a) or not len(b):
        return 0
    return int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b))


def _links(pairs: DataFrame, docs: DataFrame, k: int, per_cent: int, tmp: common.Scratch) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough: overlaps counted per fragment, then summed."""
    pairs = tmp.keep(pairs, "pairs")
    segments = tmp.keep(_segments(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), k), "segments")
    left = segments.select(F.col("id").alias("a"), "fragment", F.col("grams").alias("left"))
    right = segments.select(F.col("id").alias("b"), "fragment", F.col("grams").alias("right"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("sizes", pa.int64())])

    @common.tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(_bytes(x, np.uint64), _bytes(y, np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield common.batch(schema, batch.column(0), batch.column(1), [_overlap(x, y) for x, y in found], [len(x) + len(y) for x, y in found])

    met = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "left", "right")
    partial = met.mapInArrow(count, "a long, b long, both long, sizes long")
    total = partial.groupBy("a", "b").agg(F.sum("both").alias("i"), F.sum("sizes").alias("s"))
    return total.where(100 * F.col("i") >= per_cent * (F.col("s") - F.col("i"))).select("a", "b")


def connect(labels: DataFrame, links: DataFrame, tmp: common.Scratch) -> DataFrame:
    """``labels`` (id, component) after the links (a, b) have joined components; a component's label is its smallest.

    In a round every component hooks on its smallest neighbour, and two steps of
    pointer jumping shorten what has been hooked. Documents of one label move
    together, and labels only fall, so links whose ends have one label are done;
    the rounds end when all links are. Each round ends as a table in the shared
    folder.
    """
    edges = links.select("a", "b")
    while True:
        a, b = labels.select(F.col("id").alias("a"), F.col("component").alias("x")), labels.select(F.col("id").alias("b"), F.col("component").alias("y"))
        apart = tmp.keep(edges.join(a, "a").join(b, "b").where("x <> y"), "links")
        if apart.isEmpty():
            return labels
        edges = apart.select("a", "b")
        both = apart.select(F.col("x").alias("from"), F.col("y").alias("to")).union(apart.select("y", "x"))
        hooks = tmp.keep(both.groupBy("from").agg(F.least(F.min("to"), F.col("from")).alias("to")), "hooks")
        for _ in range(2):
            then = hooks.select(F.col("from").alias("to"), F.col("to").alias("then"))
            hooks = hooks.join(then, "to", "left").select("from", F.coalesce("then", "to").alias("to"))
        moved = labels.join(hooks.select(F.col("from").alias("component"), "to"), "component", "left")
        labels = tmp.keep(moved.select("id", F.coalesce("to", "component").alias("component")), "labels")


def _level() -> Column:
    return F.pmod("key", F.lit(1 << LEVEL_BITS)).cast("int").alias("level")


def _by_parts(make: Callable[[int], DataFrame], parts: int, name: str, tmp: common.Scratch) -> DataFrame:
    """The rows of ``make`` for each of the parts, a table before the next begins."""
    tables = []
    for p in range(parts):
        tables.append(tmp.keep(make(p), name))
        tmp.free()
    return reduce(DataFrame.union, tables)


def _of_several(rows: DataFrame, tmp: common.Scratch) -> DataFrame:
    """Those of the rows (id, key) whose key has several, and n, their number.

    Counts are partial before their shuffle, and a table of their own in the join, so
    that rows of one key can be split.
    """
    several = tmp.keep(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "all")
    tmp.free()
    return rows.join(several, "key").select("id", "key", "n")


def _meetings(every: DataFrame, members: DataFrame, tmp: common.Scratch) -> DataFrame:
    """id, key and weight: the keys of several ids (id, key, n), without the most frequent ones that a set can do without.

    Of the keys that the same ids have the smallest stays, and weight is their number.
    """
    own = members.select("id", F.col("level").alias("first"), "over").dropDuplicates(["id"])
    turn = F.row_number().over(Window.partitionBy("id", "level").orderBy(F.desc("n"), "key"))
    # by id first: rows of one id may have keys in common, and all that follows goes by id
    ranked = every.repartition("id").distinct().join(own, "id").withColumn("level", _level()).withColumn("turn", turn)
    rows = tmp.keep(ranked.where(F.col("turn") > F.get("over", F.col("level") - F.col("first"))).select("id", "key"), "all")
    # who meets under a key: their number, the first and the last, and two sums of 64-bit hashes
    who = [F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")]
    keys = rows.groupBy("key").agg(*who).where("n > 1").groupBy("n", "least", "most", "x", "y").agg(F.min("key").alias("key"), F.count("*").alias("weight"))
    return rows.join(tmp.keep(keys.select("key", "weight"), "all"), "key").select("id", "key", "weight")


def _hub_pairs(met: DataFrame, labels: DataFrame, second: bool, tmp: common.Scratch) -> DataFrame:
    """A pair (a, b, level) for each document that meets a hub of another component: the one it shares most keys with.

    The hub of a meeting is a document of its smallest component, or with
    ``second`` the smallest of the others.
    """
    rows = met.join(labels, "id")
    hub = rows.groupBy("key").agg(F.min_by("id", F.struct("component", "id")).alias("hub"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    if second:  # a hub from what the smallest component has left over
        hub = rows.join(hub.select("key", "least"), "key").where("component <> least").groupBy("key").agg(F.min("id").alias("hub"))
    home = labels.select(F.col("id").alias("hub"), F.col("component").alias("home"))
    # tables of their own on both sides, so that the join's large keys can be split
    hub, rows = tmp.keep(hub.select("key", "hub").join(home, "hub"), "hubs"), tmp.keep(rows, "rows")
    shared = rows.join(hub, "key").where("component <> home").groupBy("id", "hub").agg(F.sum("weight").alias("n"), F.min(_level()).alias("level"))
    best = shared.groupBy("id").agg(F.max_by(F.struct("hub", "level"), F.struct("n", "hub")).alias("best")).select("id", "best.*")
    return best.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"), "level").distinct()


def _open(met: DataFrame, labels: DataFrame, tmp: common.Scratch) -> DataFrame:
    """key, id, component and number of blocks of the meetings of several components."""
    rows = tmp.keep(met.join(labels, "id"), "rows")
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    keys = tmp.keep(keys.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "keys")
    return rows.join(keys, "key").select("key", "id", "component", "blocks")


def _block_pairs(rows: DataFrame, marks: DataFrame, per_cent: int, pairs: bool) -> DataFrame:
    """a and b that meet, are of different components, and that digests (id, level, n, digest) do not rule out.

    Without ``pairs``: key and id of all that have such a partner.
    """
    full = rows.withColumn("level", _level()).join(marks, ["id", "level"])
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # each row goes to its block's meetings with all blocks of the key
    dealt = full.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "n", "digest")
    names = ("a", "b") if pairs else ("key", "id")
    schema = pa.schema([(n, pa.int64()) for n in names])

    @common.tidied
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []

        def note(key: int, a: np.ndarray, b: np.ndarray) -> None:
            if pairs:
                out.append((np.minimum(a, b), np.maximum(a, b)))
            else:
                ids = np.unique(np.concatenate([a, b]))
                out.append((np.full(len(ids), key), ids))

        def close() -> None:
            """Compare the rows of a meeting's two blocks: (own, id, component, n, digest)."""
            (key, i, j), rest = at, held
            if len({r[2] for r in rest}) < 2:
                return
            if len(rest) == 2:
                (p, a, _, n, x), (q, b, _, m, y) = rest
                if i == j or p != q:
                    differ = np.count_nonzero(np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8))
                    if _possible(differ, n, m, per_cent):
                        note(key, np.array([a]), np.array([b]))
                return
            own, ids, comp, sizes, marks = zip(*rest, strict=True)
            own, ids, comp, sizes = np.array(own), np.array(ids), np.array(comp), np.array(sizes)
            marks = np.frombuffer(b"".join(marks), np.uint8).reshape(len(rest), -1)
            left, right = [], []
            for x in range(len(rest) - 1):
                y = np.flatnonzero(comp[x + 1 :] != comp[x]) + x + 1
                if i != j:
                    y = y[own[y] != own[x]]
                y = y[_possible(np.count_nonzero(marks[y] != marks[x], axis=1), sizes[y], sizes[x], per_cent)]
                if len(y):
                    left.append(np.full(len(y), ids[x]))
                    right.append(ids[y])
            if left:
                note(key, np.concatenate(left), np.concatenate(right))

        def made() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            out.clear()
            return common.batch(schema, *columns)

        for b in batches:
            for key, i, j, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, i, j) != at:
                    if len(held) > 1:
                        close()
                        if len(out) > 5000:
                            yield made()
                    at, held = (key, i, j), []
                held.append(tuple(rest))
        if len(held) > 1:
            close()
        if out:
            yield made()

    met_blocks = common.spread(dealt, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return met_blocks.mapInArrow(compare, f"{names[0]} long, {names[1]} long").distinct()


def components(docs: DataFrame, k: int, per_cent: int) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 times the intersection of their sets of
    ``k``-word shingles is at least ``per_cent`` times the union; component_id is
    the smallest doc_id that links reach. Null or blank texts have an empty set,
    linked with nothing, and are their own component. Rows that share a doc_id
    are one document, linked by any of its texts. A row with a null doc_id has its shingles counted,
    but is no node: it is linked with nothing, and its component is null. Extra columns are left out; an empty table gives
    no rows. The sets are compared exactly, on 64-bit hashes of their n-grams.
    """
    docs = docs.select("doc_id", "text")
    with common.Scratch(docs.sparkSession) as tmp:
        several = _renumbered(docs, tmp)
        if several is None:
            return common.written(_components(docs, k, per_cent, tmp), "near-duplicates")
        docs, again = several
        # the components of the single texts, joined wherever texts share an id
        made = tmp.keep(_components(docs, k, per_cent, tmp), "texts").withColumnRenamed("doc_id", "id")
        made = tmp.keep(made.join(again, "id", "left").select("id", "n_shingles", "component_id", F.coalesce("doc_id", "id").alias("doc_id")), "named")
        real = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
        hub = real.groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("z")).where("a <> z").select("doc_id", "a")
        links = tmp.keep(real.join(hub, "doc_id").where("a <> component_id").select("a", F.col("component_id").alias("b")).distinct(), "links")
        whole = connect(made.where("component_id IS NOT NULL").select(F.col("component_id").alias("id"), F.col("component_id").alias("component")).distinct(), links, tmp)
        made = tmp.keep(made.join(whole.select(F.col("id").alias("component_id"), "component"), "component_id", "left"), "joined")
        least = tmp.keep(made.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
        out = made.drop("component_id").join(least, "component", "left").select("doc_id", "n_shingles", "component_id")
        return common.written(out, "near-duplicates")


def _renumbered(docs: DataFrame, tmp: common.Scratch) -> tuple[DataFrame, DataFrame] | None:
    """If rows of different texts share ids: the documents with an id of its own for each such row, and what stood for what.

    The new ids are above all others. None if no texts share an id.
    """
    hashes = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"))
    several = hashes.groupBy("doc_id").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).where("least <> most").select("doc_id")
    several = tmp.keep(several, "several")
    if several.isEmpty():
        return None
    top = hashes.agg(F.max("doc_id")).first()[0] + 1
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # numbered in the written table, so that a repeated task cannot number anew
    again = tmp.keep(_with_ids(named, several, "doc_id").withColumn("id", F.lit(top) + F.monotonically_increasing_id()), "again")
    rest = named.join(several, "doc_id", "left_anti")
    return rest.union(again.select("id", "text")), again.select("id", "doc_id")


def _components(docs: DataFrame, k: int, per_cent: int, tmp: common.Scratch) -> DataFrame:
    """What components() gives, for documents whose texts are the same if their ids are; lasts as long as ``tmp``."""
    sets = tmp.keep(_sets(docs, k, per_cent), "sets")
    classes = tmp.keep(sets.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    members = tmp.keep(sets.select("doc_id", "n_shingles", "digest", "level", "over"), "members")
    firsts = tmp.keep(classes.select("id").distinct(), "firsts")
    of_firsts = lambda rows: _with_ids(rows.withColumnRenamed("doc_id", "id"), firsts, "id")
    every = _by_parts(lambda p: _of_several(of_firsts(sets.select("doc_id", f"keys_{p}")).select("id", F.explode(f"keys_{p}").alias("key")), tmp), PARTS, "all", tmp)
    tmp.drop("sets")
    met = tmp.keep(_meetings(every, of_firsts(members), tmp), "met")
    tmp.drop("all")
    labels = tmp.keep(met.select("id").distinct().withColumn("component", F.col("id")), "labels")
    marks = tmp.keep(_digest_rows(docs, labels.select("id"), k, per_cent), "marks")
    for second in (False, True):
        pairs = _not_ruled_out(_hub_pairs(met, labels, second, tmp), marks, per_cent)
        labels = connect(labels, _links(pairs, docs, k, per_cent, tmp), tmp)
        tmp.drop("segments")
        tmp.drop("rows")
    open_rows = tmp.keep(_open(met, labels, tmp), "open")
    digest = lambda name: marks.select("id", "level", "n", F.col(name).alias("digest"))
    left = tmp.keep(_block_pairs(open_rows, digest("coarse"), per_cent, pairs=False), "left")
    rest = tmp.keep(open_rows.join(left, ["key", "id"]), "open")
    tmp.free()
    part = F.shiftrightunsigned("key", LEVEL_BITS) % FINE_PARTS
    pairs = _by_parts(lambda p: _block_pairs(rest.where(part == p), digest("fine"), per_cent, pairs=True), FINE_PARTS, "possible", tmp).distinct()
    labels = connect(labels, _links(pairs, docs, k, per_cent, tmp), tmp)
    tmp.drop("open")
    of_class = classes.join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    of_class = tmp.keep(of_class, "components")
    out = members.join(of_class, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents: three-word shingles, nine tenths."""
    return components(common.table(spark, sf_dir, "documents", "doc_id", "text"), 3, 90)


QUERIES = {"op4_ngram_join": op4_ngram_join}
ORACLE_SQL = {
    "op4_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + least(3, len(w)) - 1], ' ') AS gram
  FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(s) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
f AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
h AS (SELECT doc_id, gram FROM g JOIN f USING (gram)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id"""
}
