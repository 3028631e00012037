"""Ranked lexical search over dual-sorted wavelet trees (operator 12).

Texts are indexed in shards where they are read: for each term of a shard the
documents that hold it and how often. A search lays the lists of its terms end
to end, each by descending impact, and splits them by document over the levels
of a wavelet tree: in every node, which stands for a range of documents, a
list's part is still one stretch by descending impact, so its first entry
bounds all of it, and the sum of the first entries bounds every document of the
range. Nodes are opened best bound first; what cannot reach the k best found so
far is never opened, and a leaf is one document with its exact score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of the texts of a shard, queries in a block, queries searched together, nodes of a query opened at once, and blocks whose bests a task holds.
SHARD, QUERIES_A_BLOCK, TILE, OPENED, HELD = 4 << 20, 256, 32, 192, 64
#: Fixed value: what parts terms, all ASCII that is neither letter nor digit.
PARTING = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SHARD_DDL = "shard string, docs array<bigint>, lengths array<bigint>, terms array<string>, found array<int>, places binary, times binary"
_NULL = np.iinfo(np.int64).max


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many terms each text has, and all terms in a row."""
    clean = pc.utf8_trim(pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), PARTING, " "), " ")
    lists = pc.split_pattern(clean, " ")
    counts = np.where(pc.equal(clean, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy())
    flat = lists.flatten()
    return counts, flat.filter(pc.not_equal(flat, ""))


class WaveletTree:
    """Lists of (document, impact), each by descending impact, split by document level for level.

    ``zeros[l]`` counts the entries before a place of level l that go to the
    lower half of their node; ``impacts[l]`` are the impacts in the order of
    level l. Documents are numbered from 0 in ascending order of their ids.
    """

    def __init__(self, docs: np.ndarray, impacts: np.ndarray, n: int):
        self.levels = max(0, int(n - 1).bit_length())
        self.zeros = np.zeros((self.levels, len(docs) + 1), np.int32)
        self.impacts = np.empty((self.levels + 1, len(docs)), np.int32)
        self.impacts[0] = impacts
        for at in range(self.levels):
            upper = docs >> (self.levels - 1 - at)
            np.cumsum(1 - (upper & 1), out=self.zeros[at, 1:])
            order = np.argsort(upper.astype(np.uint16) if n <= 1 << 16 else upper, kind="stable")
            docs = docs[order]
            self.impacts[at + 1] = self.impacts[at, order]


class Best:
    """The k best documents of each of some queries: highest score first, then smallest id, null ids last."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.last = k, np.ones(n, np.int64), np.full(n, _NULL)
        self.query, self.score, self.none, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        q, s, x, i = (np.concatenate(c) for c in ((self.query, query), (self.score, score), (self.none, none), (self.id, ids)))
        order = np.lexsort((i, x, -s, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        order, full = order[kept], place[kept] == self.k - 1
        self.query, self.score, self.none, self.id = q[kept], s[order], x[order], i[order]
        self.least[self.query[full]] = self.score[full]
        self.last[self.query[full]] = np.where(self.none[full], _NULL, self.id[full])

    def open(self, query: np.ndarray, bound: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether documents of at most ``bound``, whose smallest id is ``first``, may be among the best."""
        return (bound > self.least[query]) | (bound == self.least[query]) & (first <= self.last[query])


def search(tree: WaveletTree, ids: np.ndarray, none: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], best: Best) -> int:
    """Add the shard's documents to ``best``; returns how many nodes were opened.

    ``lists`` are, for each term of each query, the query, the weight, and the
    stretch of the term's list, ordered by query. ``ids`` ascend.
    """
    query, weight, begin, end = lists
    names, owner = np.unique(query, return_inverse=True)
    n = len(names)
    # nodes: their query, level, number in the level, and stretch of all lists; entries: owner, weight, stretch of one list
    q, level, prefix, left, right = names, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, tree.impacts.shape[1])
    keys = np.where(none, _NULL, ids)

    def bounds(owner: np.ndarray, weight: np.ndarray, begin: np.ndarray, level: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        return np.add.reduceat(weight * tree.impacts[level[owner], begin], starts)

    opened = 0
    bound = bounds(owner, weight, begin, level) if n else np.zeros(0, np.int64)
    while len(q):
        fine = best.open(q, bound, keys[prefix << (tree.levels - level)])
        done = fine & (level == tree.levels)
        if done.any():
            doc = prefix[done]
            best.add(q[done], bound[done], none[doc], ids[doc])
            fine &= ~done
            fine &= best.open(q, bound, keys[np.where(fine, prefix << (tree.levels - level), 0)])
        order = np.flatnonzero(fine)
        order = order[np.lexsort((-bound[order], q[order]))]
        now = np.zeros(len(q), bool)
        now[order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < OPENED]] = True
        later = fine & ~now
        opened += int(now.sum())
        # the chosen nodes give way to their halves, of which only those with entries count
        number = np.cumsum(now) - 1
        mine = now[owner]
        own, w, s, e = number[owner[mine]], weight[mine], begin[mine], end[mine]
        at, low, high, pre, qn = level[now], left[now], right[now], prefix[now], q[now]
        before, cut = tree.zeros[at, low], tree.zeros[at, high]
        s0, e0 = tree.zeros[at[own], s] - before[own], tree.zeros[at[own], e] - before[own]
        middle = low + cut - before
        s1, e1 = s - low[own] - s0, e - low[own] - e0
        halves = []
        for half, (first, last, base, lo, hi) in enumerate(((s0, e0, low, low, middle), (s1, e1, middle, middle, high))):
            some = last > first
            owners, o = np.unique(own[some], return_inverse=True)
            halves.append((qn[owners], at[owners] + 1, 2 * pre[owners] + half, lo[owners], hi[owners], o, w[some], (base[own] + first)[some], (base[own] + last)[some]))
        if later.any():
            rest = later[owner]
            o = (np.cumsum(later) - 1)[owner[rest]]
            halves.append((q[later], level[later], prefix[later], left[later], right[later], o, weight[rest], begin[rest], end[rest]))
        made = np.cumsum([0, *[len(h[0]) for h in halves[:-1]]])
        q, level, prefix, left, right = (np.concatenate([h[i] for h in halves]) for i in range(5))
        owner = np.concatenate([h[5] + m for h, m in zip(halves, made, strict=True)])
        weight, begin, end = (np.concatenate([h[i] for h in halves]) for i in range(6, 9))
        bound = bounds(owner, weight, begin, level) if len(q) else np.zeros(0, np.int64)
    return opened


def index(docs: DataFrame) -> DataFrame:
    """Shards of the texts of ``docs`` (doc_id, text): ids and numbers of terms of their documents, and for each term the documents and how often it stands there.

    Every task indexes what it reads; nothing is shuffled. Documents of a shard
    ascend by id, null ids last.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, made = pa.schema([("shard", pa.string()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("found", pa.list_(pa.int32())), ("places", pa.binary()), ("times", pa.binary())]), 0
        for b in batches:
            order = pc.sort_indices(b.column(0), null_placement="at_end")
            ids, texts = b.column(0).take(order), pc.fill_null(b.column(1), "").take(order)
            for first, some in common._slices(texts, SHARD):
                counts, flat = terms_of(some)
                coded = flat.dictionary_encode()
                names = coded.dictionary.to_pylist()
                cells = coded.indices.to_numpy().astype(np.int64) * len(some) + np.repeat(np.arange(len(some)), counts)
                cells, times = np.unique(cells, return_counts=True)
                made += 1
                found = np.bincount(cells // len(some), minlength=len(names))
                mine = ids.slice(first, len(some))
                yield common.batch(schema, [f"{TaskContext.get().partitionId()}-{made}"], pa.array([mine.to_pylist()], schema.field("docs").type), [counts], pa.array([names], schema.field("terms").type), [found], [common.packed_numbers(cells % len(some))], [common.packed_numbers(times)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.tidied(work), _SHARD_DDL)


def _asked(items: DataFrame) -> DataFrame:
    """Queries: a key of each row, its item_id, and its terms, once each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, made = pa.schema([("query", pa.string()), ("item_id", pa.int64()), ("terms", pa.list_(pa.string()))]), 0
        for b in batches:
            counts, flat = terms_of(b.column(1))
            ends = np.cumsum(counts)
            terms = [sorted(set(flat.slice(e - c, c).to_pylist())) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
            keys = [f"{TaskContext.get().partitionId()}-{made + i}" for i in range(b.num_rows)]
            made += b.num_rows
            yield common.batch(schema, keys, b.column(0), pa.array(terms, schema.field("terms").type))

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(work, "query string, item_id long, terms array<string>")


def _weighted(shards: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """query, term and weight of the terms of queries that documents hold."""
    terms = asked.select("query", F.explode("terms").alias("term"))
    held = shards.select(F.explode(F.arrays_zip("terms", "found")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.found").cast("long").alias("n"))
    df = held.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    ratio = F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double")
    return terms.join(df, "term").select("query", "term", F.floor(1000 * F.log(ratio)).cast("long").alias("weight"))


def _impacts(times: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """The impact of terms that stand ``times`` in documents of ``lengths`` terms, of ``n`` documents and ``total`` terms."""
    if len(lengths) and 50 * int(lengths.max()) * n >= 2**63:
        m = np.array([50 + 50 * int(v) * n // total for v in lengths], np.int64)
    else:
        m = 50 + 50 * lengths * n // total
    return 1_000_000_000 * times // (1000 * times + 20 * m)


def top_k(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents with a score above 0.

    ``docs`` holds doc_id and text, ``items`` item_id and text; other columns
    play no part. Null and termless texts score nothing and are not counted.
    Equal scores go by doc_id, null ones last. Every row is a document, or an
    item, of its own: repeated rows are ranked one by one. Whole texts count,
    however long, and must fit into a worker's memory. Empty tables give no
    rows. The search is exact.
    """
    spark = docs.sparkSession
    with common.Scratch(spark) as tmp:
        shards = tmp.keep(index(docs), "shards")
        size = shards.select(F.aggregate("lengths", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total")), lambda a, v: F.struct((a["n"] + (v > 0).cast("long")).alias("n"), (a["total"] + v).alias("total"))).alias("s"))
        n, total = size.agg(F.coalesce(F.sum("s.n"), F.lit(0)), F.coalesce(F.sum("s.total"), F.lit(0))).first()
        asked = tmp.keep(_asked(items), "asked")
        blocks = max(1, math.ceil(asked.count() / QUERIES_A_BLOCK))
        words = _weighted(shards, asked, n).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
        packed = tmp.keep(words.groupBy("block").agg(F.collect_list(F.struct("query", "term", "weight")).alias("asked")), "blocks")
        found = tmp.keep(_searched(shards, packed, n, total, k), "found")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
        return common.written(ranked.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score"), "ranked")


def _searched(shards: DataFrame, packed: DataFrame, n: int, total: int, k: int) -> DataFrame:
    """query, doc_id and score: of each query the ``k`` best of the shards of each task.

    Blocks of queries meet all shards, dealt over the tasks; a task hands on
    what it has found from shard to shard, so later shards are pruned by it.
    """
    schema = pa.schema([("query", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())])
    buckets = common.shuffle_partitions(shards.sparkSession)
    everywhere = packed.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    met = shards.withColumn("bucket", F.pmod(F.xxhash64("shard"), F.lit(buckets)).cast("int")).hint("merge").join(everywhere, "bucket")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[str], Best]] = {}
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(j)[i] for j, name in enumerate(b.schema.names)}
                block = row["block"].as_py()
                asked = row["asked"].values.flatten()
                names, query = np.unique(asked[0].to_numpy(zero_copy_only=False), return_inverse=True)
                if block not in held:
                    if len(held) >= HELD:
                        yield from _told(held, schema)
                        held.clear()
                    held[block] = (names.tolist(), Best(len(names), k))
                _search_shard(row, query, asked[1], asked[2].to_numpy(), n, total, held[block][1])
        yield from _told(held, schema)

    return met.select("docs", "lengths", "terms", "found", "places", "times", "block", "asked").mapInArrow(common.tidied(work), "query string, doc_id long, score long")


def _told(held: dict[int, tuple[list[str], Best]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for names, best in held.values():
        yield common.batch(schema, [names[q] for q in best.query], pa.array(best.id, mask=best.none), best.score)


def _search_shard(row: dict, query: np.ndarray, terms: pa.Array, weights: np.ndarray, n: int, total: int, best: Best) -> None:
    """Search a shard for a block of queries, given as the queries, terms and weights of their words."""
    docs, names = row["docs"].values, row["terms"].values
    asked, which = np.unique(terms.to_numpy(zero_copy_only=False), return_inverse=True)
    at = pc.index_in(pa.array(asked, pa.string()), names)  # of each word asked for, its list in this shard
    here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    if not len(here):
        return
    mine = at.take(pa.array(here)).to_numpy()
    found = row["found"].values.to_numpy()
    ends = np.cumsum(found, dtype=np.int64)
    sizes = found[mine].astype(np.int64)
    stop = np.cumsum(sizes)
    places = np.repeat(ends[mine] - stop, sizes) + np.arange(stop[-1])
    doc = common.unpacked_numbers(row["places"].as_py())[places].astype(np.int64)
    times = common.unpacked_numbers(row["times"].as_py())[places].astype(np.int64)
    impact = _impacts(times, row["lengths"].values.to_numpy()[doc], n, total)
    order = np.lexsort((doc, -impact, np.repeat(np.arange(len(mine)), sizes)))
    tree = WaveletTree(doc[order], impact[order], len(docs))
    none = docs.is_null().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(docs, 0).to_numpy()
    place = np.full(len(asked), -1)
    place[here] = np.arange(len(here))
    word = place[which]
    order = np.argsort(query, kind="stable")
    order = order[(word[order] >= 0) & (weights[order] > 0)]
    for i in range(0, int(query.max(initial=-1)) + 1, TILE):
        some = order[(query[order] >= i) & (query[order] < i + TILE)]
        if len(some):
            search(tree, ids, none, (query[some], weights[some], (stop - sizes)[word[some]], stop[word[some]]), best)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return top_k(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "benchmark", "item_id", "text"), 50)


_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
QUERIES = {"op12_lexical_search": op12_lexical_search}
ORACLE_SQL = {
    "op12_lexical_search": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, {_TERM}) AS w FROM documents WHERE text IS NOT NULL),
p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
s AS MATERIALIZED (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all({_LOWER.format("text")}, {_TERM})) AS w FROM benchmark WHERE text IS NOT NULL),
t AS (SELECT q, item_id, unnest(w) AS term FROM i),
f AS MATERIALIZED (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM t) GROUP BY term),
x AS (
  SELECT q, item_id, d.doc_id, d.r, CAST(sum(CAST(floor(1000 * ln((2 * s.n + 2) / (2 * f.df + 1))) AS BIGINT)
    * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + (50 * len(d.w) * s.n) // s.l)))) AS BIGINT) AS score
  FROM t JOIN f USING (term) JOIN p USING (term) JOIN d USING (r), s GROUP BY ALL
), k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS "rank", doc_id, score FROM x WHERE score > 0)
SELECT item_id, "rank", doc_id, score FROM k WHERE "rank" <= 50"""
}
