"""Repeated passages inside and across lines, as substring dedup (operator 2) removes them.

Lines go as in substring_dedup. Besides, a window of ``WINDOW`` words in a row
(A-Z lower-cased, parted by ASCII white space, line breaks too) that occurs at an
earlier place goes, wherever it lies in its lines. The earliest is that of the
lowest doc_id, then text hash, then place, and every other word that goes has its
equal at an earlier place. Windows are winnowed: of the ``GRAM``-word grams of a
window the one of the smallest hash is its anchor, so equal windows have equal
anchors, and only where an anchor repeats is anything compared, by 128-bit digests.
Windows in a row of one anchor are a block. A block whose words have an earlier
place goes whole, since its windows have it too, and the earliest place of any
window is in a block that does not go so. The windows of such blocks are compared
one by one where an anchor has several of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .substring_dedup import PASSAGE_WORDS, repeats

#: Words of a window, the shortest passage that goes, and of the grams that anchor it.
WINDOW, GRAM = PASSAGE_WORDS + 1, 25
#: Windows that one place of an anchor can serve, and the most of a block.
SERVED = WINDOW - GRAM + 1
#: Anchors that may be broadcast, of 8 bytes each; beyond it they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
_LANES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_DOC = "doc_id long, text_hash long"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _grams(words: np.ndarray, n: int, lane: np.uint64) -> np.ndarray:
    """A hash of each ``n`` words in a row, put together from those of powers of two."""
    out, part, size, done = None, words, 1, 0
    while True:
        if n & size:
            out, done = (part if out is None else _mixed(out[: len(part) - done] * lane + part[done:])), done + size
        if size * 2 > n:
            return out
        part, size = _mixed(part[:-size] * lane + part[size:]), size * 2


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts in a row, and where each text's words end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten().dictionary_encode()
    known = words.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter((int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in known), np.uint64, len(known))
    at, offsets = words.indices.to_numpy(), lists.offsets.to_numpy()
    full = np.fromiter(map(bool, known), bool, len(known))[at]  # white space at an end parts off an empty word
    return hashes[at[full]], np.concatenate([[0], np.cumsum(full)])[offsets[1:] - offsets[0]]


def _anchors(words: np.ndarray) -> np.ndarray:
    """The anchor of each window."""
    least, size = _mixed(_grams(words, GRAM, _LANES[0])), 1
    while size < SERVED:
        step = min(size, SERVED - size)
        least, size = np.minimum(least[:-step], least[step:]), size + step
    return least.view(np.int64)


def _windows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some texts at a time: the words' hashes, and of each window its anchor, its first word there, its text and its first word in it."""
    for first, part in common._slices(pc.fill_null(texts, ""), common.SLICE):
        words, ends = _words(part)
        if len(words) < WINDOW:
            continue
        anchors, begins = _anchors(words), np.concatenate([[0], ends[:-1]])
        of = np.repeat(np.arange(len(ends)), ends - begins)[: len(anchors)]
        at = np.flatnonzero(np.arange(WINDOW, WINDOW + len(of)) <= ends[of])
        of = of[at]
        if not len(at):
            continue
        yield words, anchors[at], at, first + of, at - begins[of]


def _blocks(found: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each block and its number of windows."""
    new, i = (np.diff(found, prepend=0) != 0) | (np.diff(of, prepend=-1) != 0), np.arange(len(of))
    new |= (i - np.maximum.accumulate(np.where(new, i, 0))) % SERVED == 0
    first = np.flatnonzero(new)
    return first, np.diff(first, append=len(of))


def _keys(docs: DataFrame) -> DataFrame:
    """The anchor of each block."""
    schema = pa.schema([("key", pa.int64())])

    @common.tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, found, _, of, _ in _windows(b.column(0)):
                yield common.batch(schema, found[_blocks(found, of)[0]])

    return docs.select("text").mapInArrow(work, "key long")


def _block_rows(docs: DataFrame) -> DataFrame:
    """The blocks: anchor, digest of all words, and place."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    @common.tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, found, at, of, start in _windows(b.column(2)):
                first, n = _blocks(found, of)
                digests = []
                for lane in _LANES:  # the first and the last window hold all words of a block
                    w = _grams(words, WINDOW, lane)[at]
                    digests.append(_mixed(w[first] * lane + _mixed(w[first + n - 1] + n.astype(np.uint64))).view(np.int64))
                rows = pa.array(of[first])
                yield common.batch(schema, found[first], *digests, b.column(0).take(rows), b.column(1).take(rows), start[first].astype(np.int32), n.astype(np.int32))

    return docs.select("doc_id", "text_hash", "text").mapInArrow(work, f"key long, a long, b long, {_DOC}, start int, n int")


def _window_rows(docs: DataFrame) -> DataFrame:
    """The windows of the blocks of ``docs`` (doc_id, text_hash, text, blocks): digest and place."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32())])

    @common.tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(3).flatten()
            owner = np.repeat(np.arange(len(b)), b.column(3).value_lengths().to_numpy())
            begin, size = (pc.struct_field(flat, f).to_numpy() for f in ("start", "n"))
            for words, _, at, of, start in _windows(b.column(2)):
                some = (owner >= of[0]) & (owner <= of[-1])
                n = size[some]
                first = np.searchsorted((of << 32) + start, (owner[some] << 32) + begin[some])
                held = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                a, c = (_grams(words, WINDOW, lane)[at[held]].view(np.int64) for lane in _LANES)
                rows = pa.array(of[held])
                yield common.batch(schema, a, c, b.column(0).take(rows), b.column(1).take(rows), start[held].astype(np.int32))

    return docs.select("doc_id", "text_hash", "text", "blocks").mapInArrow(work, f"a long, b long, {_DOC}, start int")


def _joined(docs: DataFrame, per: DataFrame, how: str) -> DataFrame:
    """Documents with what was found of them; a null id equals itself."""
    per = per.withColumnsRenamed({"doc_id": "of_id", "text_hash": "of_hash"})
    return docs.join(per, docs["doc_id"].eqNullSafe(F.col("of_id")) & (docs["text_hash"] == F.col("of_hash")), how).drop("of_id", "of_hash")


def _judged(rows: DataFrame, tmp: common.Scratch) -> DataFrame:
    """Blocks or windows, and whether they are ``later``: equal to one of an earlier place that they do not overlap."""
    place = F.min(F.struct("doc_id", "text_hash", "start")).alias("first")
    # a table of its own, so that the join's large keys can be split
    first = tmp.keep(rows.groupBy("a", "b").agg(place, F.count("*").alias("copies")).where("copies > 1").drop("copies"), "first")
    own = F.struct("doc_id", "text_hash").eqNullSafe(F.struct("first.doc_id", "first.text_hash"))
    later = F.col("first").isNotNull() & (~own | (F.col("start") >= F.col("first.start") + WINDOW))
    return rows.join(first, ["a", "b"], "left").withColumn("later", F.coalesce(later, F.lit(False)))


def later_windows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start (a word's number) and n of windows in a row that occur at earlier places.

    Of a document's own windows only those count that do not overlap the first.
    """
    some = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    with common.Scratch(docs.sparkSession) as tmp:  # a drop also frees the shuffles before it
        keys = tmp.keep(_keys(docs).groupBy("key").count().where("count > 1").select("key"), "keys")
        blocks = tmp.keep(_block_rows(docs).join(some(keys), "key"), "blocks")
        tmp.drop("keys")
        judged = tmp.keep(_judged(blocks, tmp).select("key", "doc_id", "text_hash", "start", "n", "later"), "judged")
        tmp.drop("blocks")
        open_ = judged.where("not later")
        keys = tmp.keep(open_.groupBy("key").count().where("count > 1").select("key"), "keys")
        held = tmp.keep(open_.join(some(keys), "key").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("blocks")), "held")
        tmp.drop("first")
        passages = tmp.keep(_joined(docs.select("doc_id", "text_hash", "text"), held, "inner"), "passages")
        tmp.drop("held")
        windows = _judged(_window_rows(passages), tmp).withColumn("n", F.lit(1))
        out = common.written(judged.unionByName(windows, allowMissingColumns=True).where("later").select("doc_id", "text_hash", "start", "n"), "later")
        tmp.drop("passages")
    return out


MADE = pa.struct([("text", pa.string()), ("n_removed", pa.int32()), ("n_cut", pa.int32()), ("n_passages", pa.int32())])
_NEW = ("n_removed", "n_cut", "n_passages")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with the text without repeating lines and passages, n_removed, n_cut and n_passages.

    ``n_removed`` counts the repeating lines that go, ``n_cut`` the words that go
    from other lines; a line of which no word is left goes whole. ``n_passages``
    counts the runs of words that repeating windows cover, in any lines. A null
    text stays null, an empty one empty; blank lines stay. Rows that repeat a
    doc_id and its text are one document and end alike; a null doc_id ranks
    first. Columns of the new names are replaced; an empty table gives no rows.
    """
    docs = docs.drop(*_NEW).withColumn("text_hash", F.xxhash64("text"))
    none = F.lit(None)
    lines = repeats(docs).where("not kept").select("doc_id", "text_hash", "line", none.cast("struct<start: int, n: int>").alias("run"))
    words = later_windows(docs).select("doc_id", "text_hash", none.cast("int").alias("line"), F.struct("start", "n").alias("run"))
    per = lines.unionByName(words).groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("lines"), F.collect_set("run").alias("runs"))

    @F.arrow_udf("struct<text: string, n_removed: int, n_cut: int, n_passages: int>")
    def cut(texts: pa.Array, lines: pa.Array, runs: pa.Array) -> pa.Array:
        return pa.array([_cut(t.as_py(), x.as_py(), r.as_py()) for t, x, r in zip(texts, lines, runs, strict=True)], type=MADE)

    made = _joined(docs, per, "left").withColumn("made", cut("text", "lines", "runs"))
    return made.select(*[F.col("made.text").alias(c) if c == "text" else F.col(c) for c in docs.columns if c != "text_hash"], *[f"made.{c}" for c in _NEW])


def _cut(text: str | None, later: list[int] | None, runs: list[dict] | None) -> dict:
    gone, kept, n_cut, n_passages = set(later or ()), [], 0, 0
    if not gone and not runs:
        return {"text": text, "n_removed": 0, "n_cut": 0, "n_passages": 0}
    inside, reach = set(), -1
    for start, n in sorted((r["start"], r["n"]) for r in runs):
        n_passages += start > reach
        inside.update(range(max(start, reach), start + n - 1 + WINDOW))
        reach = max(reach, start + n - 1 + WINDOW)
    unit = word = 0
    for line in text.split("\n"):
        spans = [m.span() for m in _WORD.finditer(line)]
        marked = [word + i in inside for i in range(len(spans))]
        word += len(spans)
        if not spans:
            kept.append(line)
            continue
        unit += 1
        if unit - 1 in gone:
            continue
        n_cut += sum(marked)
        if not all(marked):
            kept.append(_without(line, spans, marked) if any(marked) else line)
    return {"text": "\n".join(kept), "n_removed": len(gone), "n_cut": n_cut, "n_passages": n_passages}


def _without(line: str, spans: list[tuple[int, int]], marked: list[bool]) -> str:
    """The line without the marked words: they go with the white space before them, at its beginning with that behind."""
    first = marked.index(False)
    out, at = [line[: spans[0][0]]], spans[first][0]
    for (_, before), (_, end), m in zip(spans[first:], spans[first + 1 :], marked[first + 1 :], strict=False):
        if m:
            out.append(line[at:before] if at < before else "")
            at = end
    return "".join(out) + line[at:]


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its passages of over 50 words that go, its lines that go, the words cut from others and the text that stays."""
    out = dedup(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", *[F.col(c).cast("long") for c in ("n_passages", "n_removed", "n_cut")], "text")


QUERIES = {"op2_repeated_passages": op2_repeated_passages}
ORACLE_SQL = {
    "op2_repeated_passages": rf"""
WITH u AS (
  SELECT *, array_to_string(w, ' ') AS unit FROM (
    SELECT doc_id, i, line, regexp_extract_all(line, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS parts,
      regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM (SELECT doc_id, unnest(string_split("text", chr(10))) AS line, generate_subscripts(string_split("text", chr(10)), 1) AS i FROM documents))
), r AS (
  SELECT doc_id, i, line, parts, w, len(w) > 0 AND row_number() OVER (PARTITION BY unit ORDER BY doc_id, i) > 1 AS gone FROM u
), v AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS k
  FROM (SELECT doc_id, i, gone, unnest(parts) AS part, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM r)
), x AS (
  SELECT doc_id, s, array_to_string(ws[s + 1 : s + {WINDOW}], ' ') AS passage
  FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {WINDOW - 1})) AS s FROM (SELECT doc_id, list(word ORDER BY k) AS ws FROM v GROUP BY doc_id))
), f AS (
  SELECT doc_id, s, first_value(doc_id) OVER p AS first_id, first_value(s) OVER p AS first_s FROM x WINDOW p AS (PARTITION BY passage ORDER BY doc_id, s)
), marked AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS k FROM f WHERE doc_id <> first_id OR s >= first_s + {WINDOW}
), n AS (
  SELECT doc_id, count(*) AS n_passages FROM (SELECT doc_id, k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS step FROM marked) WHERE step IS NULL OR step > 1 GROUP BY doc_id
), m AS (
  SELECT *, min(CASE WHEN NOT cut THEN j END) OVER (PARTITION BY doc_id, i) AS first_j
  FROM (SELECT v.*, marked.k IS NOT NULL AS cut FROM v LEFT JOIN marked ON marked.doc_id = v.doc_id AND marked.k = v.k WHERE NOT v.gone)
), y AS (
  SELECT doc_id, i, count(*) FILTER (cut) AS n_cut, string_agg(CASE WHEN j = first_j THEN regexp_extract(part, '[^\x20\x09-\x0D]+') ELSE part END, '' ORDER BY j) FILTER (NOT cut) AS kept
  FROM m GROUP BY doc_id, i
), d AS (
  SELECT r.doc_id, count(*) FILTER (gone) AS n_removed, coalesce(sum(n_cut), 0) AS n_cut,
    string_agg(CASE WHEN len(w) = 0 THEN line ELSE regexp_extract(line, '^[\x20\x09-\x0D]*') || kept || regexp_extract(line, '[\x20\x09-\x0D]*$') END, chr(10) ORDER BY r.i) FILTER (len(w) = 0 OR kept IS NOT NULL) AS kept
  FROM r LEFT JOIN y ON y.doc_id = r.doc_id AND y.i = r.i GROUP BY r.doc_id
)
SELECT o.doc_id, CAST(coalesce(n.n_passages, 0) AS BIGINT) AS n_passages, CAST(coalesce(d.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(d.n_cut, 0) AS BIGINT) AS n_cut,
  CASE WHEN o."text" IS NULL THEN NULL ELSE coalesce(d.kept, '') END AS "text"
FROM documents o LEFT JOIN d ON d.doc_id = o.doc_id LEFT JOIN n ON n.doc_id = o.doc_id"""
}
