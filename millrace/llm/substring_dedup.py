"""Substring dedup (operator 2): lines are hashed, and of each text line one occurrence stays.

Lines are normalised (A-Z lower-cased, runs of ASCII white space one space) and
digested. Digests are grouped over the whole corpus, and the occurrence of the
lowest rank, which is doc_id, then the text's hash, then the line's place, is
the one that stays. Every other occurrence repeats it. Repeating lines that
follow each other in a document form a run; by default every run is removed,
with ``min_words`` only those of at least so many words. Runs of lines that other
documents have too, kept or removed, are the document's repeated passages if they
have more than ``PASSAGE_WORDS`` words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A run of lines that other documents have too is a repeated passage if it has more than so many words.
PASSAGE_WORDS = 50
#: Repeating lines that may be broadcast, of about 120 bytes each; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def lines(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """Start, end (code points), number of words and digest of each line that is not blank."""
    out, at = [], 0
    for line in text.split("\n") if text else []:
        if words := line.encode("utf-8", "surrogatepass").lower().split():
            out.append((at, at + len(line), len(words), hashlib.blake2b(b" ".join(words), digest_size=16).digest()))
        at += len(line) + 1
    return out


def _lines(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("line", pa.int32()), ("start", pa.int64()), ("digest", pa.binary())])

    @common.tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text_hash, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                rows += [(doc_id, text_hash, i, start, digest) for i, (start, _, _, digest) in enumerate(lines(text.as_py()))]
                if len(rows) > 20_000:
                    yield common.batch(schema, *zip(*rows, strict=True))
                    rows = []
            if rows:
                yield common.batch(schema, *zip(*rows, strict=True))

    return docs.select("doc_id", "text_hash", "text").mapInArrow(work, "doc_id long, text_hash long, line int, start long, digest binary")


def repeats(docs: DataFrame) -> DataFrame:
    """Every line whose digest occurs more than once: doc_id, text_hash, line, what is kept of it, and across.

    first_doc_id and first_start are those of the kept occurrence, ``kept`` says
    whether it is this one, and ``across`` whether several documents have it.
    """
    rows = _lines(docs)
    rank = F.struct("doc_id", "text_hash", "line", "start")
    # partial minima before the shuffle; a digest has one row after it
    first = rows.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first <> last")
    one = F.struct("first.doc_id", "first.text_hash").eqNullSafe(F.struct("last.doc_id", "last.text_hash"))
    # a table of its own, so that the join's large keys can be split
    first = common.written(first.select("digest", "first", (~one).alias("across")), "first")
    found = rows.join(F.broadcast(first) if first.count() <= BROADCAST_ROWS else first, "digest")
    kept = F.struct("doc_id", "text_hash", "line").eqNullSafe(F.struct("first.doc_id", "first.text_hash", "first.line"))
    return found.select("doc_id", "text_hash", "line", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"), kept.alias("kept"), "across")


MADE = pa.struct([("text", pa.string()), ("n_lines", pa.int32()), ("n_repeated", pa.int32()), ("n_passages", pa.int32()), ("n_passages_removed", pa.int32()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_doc_id", pa.int64()), ("first_start", pa.int64())])))])
MADE_DDL = "struct<text: string, n_lines: int, n_repeated: int, n_passages: int, n_passages_removed: int, removed: array<struct<start: bigint, end: bigint, first_doc_id: bigint, first_start: bigint>>>"
_NEW = ("n_lines", "n_repeated", "n_passages", "n_passages_removed", "removed")


def dedup(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """``docs``, all columns, with the text that stays and n_lines, n_repeated, n_passages, n_passages_removed and removed.

    ``removed`` lists the removed lines: start and end in the original text in
    code points, and first_doc_id and first_start of the occurrence that stays.
    A removed line goes with its line break. ``n_repeated`` counts the lines that
    other documents have too, and ``n_passages`` their runs of more than
    PASSAGE_WORDS words, whether they stay or go; ``n_passages_removed`` counts the
    runs of removed lines of more than so many words. A null text stays null, an empty
    one empty; blank lines are no units and stay. Rows that repeat a doc_id and
    its text are one document and end alike; a null doc_id ranks first. Columns
    of the new names are replaced; an empty table gives no rows.
    """
    docs = docs.drop(*_NEW).withColumn("text_hash", F.xxhash64("text"))
    per = repeats(docs).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("line", "first_doc_id", "first_start", "kept", "across")).alias("repeats"))
    per = per.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "repeats")
    both = docs.join(per, docs["doc_id"].eqNullSafe(per["of_id"]) & (docs["text_hash"] == per["of_hash"]), "left")

    @F.arrow_udf(MADE_DDL)
    def cut(texts: pa.Array, repeated: pa.Array) -> pa.Array:
        return pa.array([_cut(t.as_py(), r.as_py(), min_words) for t, r in zip(texts, repeated, strict=True)], type=MADE)

    made = both.withColumn("made", cut("text", "repeats"))
    return made.select(*[F.col("made.text").alias(c) if c == "text" else F.col(c) for c in docs.columns if c != "text_hash"], *[f"made.{c}" for c in _NEW])


def _runs(n: int, inside: set[int]) -> Iterator[range]:
    """The runs of consecutive numbers below ``n`` that are inside."""
    i = 0
    while i < n:
        j = i
        while j < n and j in inside:
            j += 1
        if j > i:
            yield range(i, j)
        i = j + 1


def _cut(text: str | None, repeated: list[dict] | None, min_words: int) -> dict:
    units = lines(text)
    later = {r["line"]: r for r in repeated or () if not r["kept"]}
    across = {r["line"] for r in repeated or () if r["across"]}
    words = lambda run: sum(units[i][2] for i in run)
    passages = lambda inside: sum(words(run) > PASSAGE_WORDS for run in _runs(len(units), inside))
    gone = [i for run in _runs(len(units), set(later)) if words(run) >= min_words for i in run]
    removed = [{"start": units[i][0], "end": units[i][1], "first_doc_id": later[i]["first_doc_id"], "first_start": later[i]["first_start"]} for i in gone]
    if gone:
        starts, at, kept = {r["start"] for r in removed}, 0, []
        for line in text.split("\n"):
            if at not in starts or not line:
                kept.append(line)
            at += len(line) + 1
        text = "\n".join(kept)
    return {"text": text, "n_lines": len(units), "n_repeated": len(across), "n_passages": passages(across), "n_passages_removed": passages(set(gone)), "removed": removed}


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated passages, the number of lines that go, the text that stays and the spans that go."""
    out = dedup(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["start"], r["end"])), ",")
    firsts = F.array_join(F.transform("removed", lambda r: r["first_doc_id"].cast("string")), ",")
    return out.select("doc_id", F.col("n_passages").cast("long"), F.col("n_passages_removed").cast("long"), F.size("removed").cast("long").alias("n_removed"), F.col("n_repeated").cast("long"), "text", spans.alias("removed_spans"), firsts.alias("first_doc_ids"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLE_SQL = {
    "op2_substring_dedup": rf"""
WITH l AS (
  SELECT doc_id, i, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split("text", chr(10))) AS line, generate_subscripts(string_split("text", chr(10)), 1) AS i FROM documents)
), p AS (
  SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l
), u AS (
  SELECT *, array_to_string(w, ' ') AS unit, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line_no FROM p WHERE len(w) > 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, line_no) AS rn, first_value(doc_id) OVER (PARTITION BY unit ORDER BY doc_id, line_no) AS first_id,
    min(doc_id) OVER (PARTITION BY unit) <> max(doc_id) OVER (PARTITION BY unit) AS across FROM u
), gone AS (SELECT * FROM r WHERE rn > 1
), g AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(line) AS BIGINT), ',' ORDER BY line_no) AS spans,
    string_agg(CAST(first_id AS VARCHAR), ',' ORDER BY line_no) AS firsts FROM gone GROUP BY doc_id
), k AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.i) AS kept
  FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i WHERE gone.i IS NULL GROUP BY p.doc_id
), shared AS (
  SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM r WHERE across
), c AS (
  SELECT doc_id, sum(n) AS n_repeated, count(*) FILTER (words > {PASSAGE_WORDS}) AS n_passages
  FROM (SELECT doc_id, island, count(*) AS n, sum(len(w)) AS words FROM shared GROUP BY doc_id, island) GROUP BY doc_id
), rg AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM gone
), pr AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, island, sum(len(w)) AS words FROM rg GROUP BY doc_id, island) WHERE words > {PASSAGE_WORDS} GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(c.n_passages, 0) AS BIGINT) AS n_passages, CAST(coalesce(pr.n, 0) AS BIGINT) AS n_passages_removed, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n_repeated, 0) AS BIGINT) AS n_repeated,
  CASE WHEN d."text" IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS "text", coalesce(g.spans, '') AS removed_spans, coalesce(g.firsts, '') AS first_doc_ids
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN pr ON pr.doc_id = d.doc_id"""
}
