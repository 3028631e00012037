"""Packing (operator 7): lexical retrieval packing into windows of token ids.

Documents are dealt out by a sketch of their rarer words and, within equal
sketches, by id, so that related documents meet in a partition and no group of
copies makes a partition large. A task takes its partition shard by shard. A
shard has a BM25 inverted index over token ids. A window begins with a seed
document; the shard's unused documents are retrieved in order of their BM25
score for the seed and fill the window greedily. The document that does not fit
is cut, and its rest is the next seed. What is left open at the end of a shard
goes on in the next; at the end of a task it is cut into windows of powers of
two, so that no window needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Documents and token ids of a shard, about: they bound a task's memory (about 60 bytes an id).
SHARD_DOCS, SHARD_IDS = 1024, 1_000_000
#: BM25 parameters.
K1, B = 1.2, 0.75
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Bm25Shard:
    """The BM25 inverted index of one shard's documents."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        found = [np.unique(d, return_counts=True) for d in docs]
        self._terms = [t for t, _ in found]
        sizes = np.array([len(t) for t in self._terms])
        terms, tf = np.concatenate(self._terms).astype(np.int64), np.concatenate([c for _, c in found])
        rows = np.repeat(np.arange(n), sizes)
        lengths = np.array([len(d) for d in docs], dtype=np.float64)
        order = np.argsort(terms, kind="stable")
        df = np.bincount(terms)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / lengths.mean())
        weights = idf[terms] * tf * (K1 + 1) / (tf + norm[rows])
        self._rows, self._weights = rows[order], weights[order].astype(np.float32)
        self._first, self._n = np.concatenate([[0], np.cumsum(df)]), n
        self._df = np.where(df >= 2, df, 0)

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 scores of all documents of the shard for the seed's terms."""
        terms = self._terms[seed]
        counts = self._df[terms]
        terms, counts = terms[counts > 0], counts[counts > 0]
        at = np.arange(counts.sum()) + np.repeat(self._first[terms] - np.cumsum(counts) + counts, counts)
        return np.bincount(self._rows[at], self._weights[at], self._n)


class Packer:
    """Windows under construction; ``done`` collects the pieces of closed ones."""

    def __init__(self, window: int, first_id: int):
        self.window, self._next = window, first_id
        self._open: list[tuple] = []
        self._fill = 0
        self.done: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray, start: int) -> int:
        """Put a document's ids from ``start`` on into the open window; where they were cut, or their number."""
        n = min(self.window - self._fill, len(ids) - start)
        self._open.append((doc_id, ids, start, n))
        self._fill += n
        if self._fill == self.window:
            self._close(self._open)
            self._open, self._fill = [], 0
        return start + n

    @property
    def empty(self) -> bool:
        return self._fill == 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, ids, start, n in pieces:
            self.done.append((doc_id, start, n, ids[start : start + n].tobytes(), len(ids), self._next, offset))
            offset += n
        self._next += 1

    def finish(self) -> None:
        """Cut the open window into windows of powers of two."""
        left, self._open = self._open, []
        while self._fill:
            size = 1 << (self._fill.bit_length() - 1)
            self._fill -= size
            taken = []
            while size:
                doc_id, ids, start, n = left.pop(0)
                taken.append((doc_id, ids, start, min(n, size)))
                if n > size:
                    left.insert(0, (doc_id, ids, start + size, n - size))
                size -= min(n, size)
            self._close(taken)

    def shard(self, docs: list[tuple[int | None, np.ndarray]]) -> None:
        """Pack the documents of a shard."""
        index = Bm25Shard([ids for _, ids in docs])
        at = [0] * len(docs)
        unused = np.ones(len(docs), bool)
        rank = np.zeros(len(docs))
        first = 0
        seed: int | None = None
        while True:
            while first < len(docs) and not unused[first]:
                first += 1
            if seed is None:
                if first == len(docs):
                    return
                seed, rank = first, index.scores(first)
            doc_id, ids = docs[seed]
            unused[seed] = False
            at[seed] = self.add(doc_id, ids, at[seed])
            if at[seed] < len(ids):  # cut: its rest begins the next window
                rank = index.scores(seed)
            elif self.empty:
                seed = None
            else:
                best = int(np.argmax(np.where(unused, rank, -1.0)))
                seed = best if unused[best] else None
                if seed is not None and rank[best] <= 0:  # nothing in common: the next in order
                    while not unused[first]:
                        first += 1
                    seed = first


def _sketch(text: Column) -> Column:
    """A hash of the smallest hash of a text's longer words, which texts with many words in common are likely to share.

    Long texts have small smallest hashes; hashed again, they lie anywhere in the order.
    """
    some = F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: F.octet_length(w) >= 12)
    return F.xxhash64(F.coalesce(F.array_min(F.transform(some, lambda w: F.xxhash64(w))), F.lit(0).cast("long")))


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """The pieces of all documents of ``docs`` (doc_id, text), packed into sequences of ``window`` ids.

    A document is its token ids and ``end_id``; null and empty texts are the end
    id alone. Each id lies in exactly one piece: doc_id, start (ids of the
    document before it), length, ids (little-endian unsigned 32-bit integers),
    doc_tokens, sequence_id and offset there. Sequences are full, but for those
    at a task's end, whose lengths are powers of two. Rows that repeat a doc_id
    are packed one by one. Extra columns are left out; an empty table gives no
    rows. Memory is bounded by a shard and the longest text.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")

    @common.tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = common.encoder(tokenizer), Packer(window, TaskContext.get().partitionId() << 32)
        shard: list[tuple[int | None, np.ndarray]] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            if packer.done:
                yield common.batch(PIECES, *zip(*packer.done, strict=True))
                packer.done.clear()

        for b in batches:
            names = b.column(0).to_pylist()
            for first, ends, ids in enc.batches(b.column(1)):
                for i, own in enumerate(np.split(ids, ends[:-1])):
                    shard.append((names[first + i], np.append(own, np.uint32(end_id))))
                    held += len(own) + 1
                    if len(shard) >= SHARD_DOCS or held >= SHARD_IDS:
                        packer.shard(shard)
                        shard, held = [], 0
                        yield from out()
        if shard:
            packer.shard(shard)
        packer.finish()
        yield from out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("sketch", _sketch(F.col("text")))
    met = rows.repartitionByRange("sketch", "doc_id").sortWithinPartitions("sketch", "doc_id", "text")
    return met.select("doc_id", "text").mapInArrow(work, PIECES_DDL)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids, with the crc32 of each piece's ids."""
    pieces = pack(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op7_packing": op7_packing}
ORACLE_SQL: dict[str, str] = {}
