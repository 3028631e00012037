"""Benchmark decontamination (operator 3) by winnowing, in DataFrame functions alone.

Of each text's hashes of ``GRAM`` words, the smallest in every sliding window is
kept as a fingerprint. A window spans ``window`` words, so two texts that share
that many words in a row share a fingerprint. Fingerprints of documents and
benchmark items are joined; where one hits, the document's word windows that
hold the hit are compared with the items' windows as text. Items of fewer words
than a window are windows themselves, and their one fingerprint is the hash of
all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words in a hashed gram.
GRAM = 6
#: A word is a run of these characters, after A-Z have become a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that may be broadcast, and those of a row without its lists and texts; beyond it tables are joined by a shuffle.
BROADCAST_BYTES, ROW_BYTES = 20_000_000, 100


def words(text: Column) -> Column:
    """The words of a text; of null none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    small = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(small, F.lit(WORD), F.lit(0))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once a row."""
    return F.transform(F.array(value), use)[0]


def _positions(n: Column) -> Column:
    """0 to n - 1, as an array that may be empty."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _gram(ws: Column, i: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(ws, i + j) for j in range(n)])


def _grams(ws: Column, n: int) -> Column:
    """The hashes of all runs of ``n`` words, in order."""
    return F.transform(_positions(F.size(ws) - (n - 1)), lambda i: _gram(ws, i, n))


def _minima(hashes: Column, w: int) -> Column:
    """The smallest of each ``w`` hashes in a row."""
    return F.array_distinct(F.transform(_positions(F.size(hashes) - (w - 1)), lambda i: F.least(*[F.get(hashes, i + j) for j in range(w)])))


def _fingerprints(ws: Column, window: int, short: list[int]) -> Column:
    """The fingerprints of words: the winnowed grams, and all runs of the lengths of short items."""
    gram = min(GRAM, window)
    found = [_once(_grams(ws, gram), lambda h: _minima(h, window - gram + 1)) if window > gram else _grams(ws, gram)]
    return F.concat(*found, *[_grams(ws, n) for n in short])


def _join_small(rows: DataFrame, other: DataFrame, on, how: str = "inner", more: Column | None = None) -> DataFrame:
    """A join that broadcasts ``other`` if it is small; larger ones are left to a shuffle. ``more`` are the bytes of a row's lists and texts."""
    each = F.lit(ROW_BYTES) if more is None else ROW_BYTES + more
    size = other.agg(F.coalesce(F.sum(each.cast("long")), F.lit(0))).first()[0]
    return rows.join(F.broadcast(other) if size <= BROADCAST_BYTES else other, on, how)


def _dealt(prints: Column) -> Column:
    """The fingerprints in about as many lists as each of them then holds: fingerprint p of n lists in list p mod n."""
    n = F.ceil(F.sqrt(F.size(prints))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(prints, lambda p: F.pmod(p, n) == i))


def _among(lists: Column, p: Column) -> Column:
    return F.array_contains(F.get(lists, F.pmod(p, F.size(lists)).cast("int")), p)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, text_hash, start, length, item_id: the item windows that occur in documents.

    ``start`` counts words from 0; ``length`` is ``window``, or all words of a
    shorter item. Every occurrence of every window is given once.
    """
    return _hits(docs, benchmark, window)[0]


def _hits(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """What hits() gives, and doc_id, text_hash and n_words of every row of ``docs``."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    items = common.written(items, "items")
    # lengths below the window: at most window - 1 numbers, whatever the benchmark's size
    short = sorted(r[0] for r in items.where(F.size("ws") < window).select(F.size("ws")).distinct().collect())
    gram = min(GRAM, window)
    own = F.when(F.size("ws") >= window, _fingerprints(F.col("ws"), window, [])).otherwise(F.filter(F.concat(*[F.when(F.size("ws") == n, _grams(F.col("ws"), n)).otherwise(F.array().cast("array<bigint>")) for n in short], F.array().cast("array<bigint>")), lambda x: x.isNotNull()))
    prints = items.select(F.explode(own).alias("print")).distinct()
    windows = items.select("item_id", F.least(F.size("ws"), F.lit(window)).alias("length"), "ws")
    said = F.transform(_positions(F.size("ws") - F.col("length") + 1), lambda i: F.array_join(F.slice("ws", i + 1, F.col("length")), " "))
    windows = common.written(windows.select("item_id", "length", F.explode(said).alias("said")).distinct(), "windows")
    prints = common.written(prints, "prints")

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    both = _once(words(F.col("text")), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), _fingerprints(ws, window, short).alias("prints")))
    marked = common.written(rows.select("doc_id", "text_hash", both.alias("b")).select("doc_id", "text_hash", "b.*"), "marked")
    met = _join_small(marked.select("doc_id", "text_hash", F.explode("prints").alias("print")), prints, "print").groupBy("doc_id", "text_hash").agg(F.collect_set("print").alias("prints"))
    met = common.written(met, "met")
    # the hit documents again, to extend the hits to whole windows
    key = [rows["doc_id"].eqNullSafe(met["doc_id"]), rows["text_hash"] == met["text_hash"]]
    found = _join_small(rows.where("text IS NOT NULL"), met, key, more=8 * F.size("prints")).select(rows["doc_id"], rows["text_hash"], words(F.col("text")).alias("ws"), _dealt(F.col("prints")).alias("prints"))
    found = found.dropDuplicates(["doc_id", "text_hash"])

    def starts(ws: Column, prints: Column, n: int, size: int) -> Column:
        """Where windows of ``size`` words begin that hold a hit gram of ``n`` words."""
        at = _once(_grams(ws, n), lambda h: F.filter(_positions(F.size(h)), lambda i: _among(prints, F.get(h, i))))
        begin = F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(p - (size - n), F.lit(0)), p)))
        return F.filter(F.array_distinct(begin), lambda s: s <= F.size(ws) - size)

    def candidates(ws: Column, prints: Column) -> Column:
        def of(n: int, size: int) -> Column:
            return F.transform(starts(ws, prints, n, size), lambda s: F.struct(s.alias("start"), F.lit(size).alias("length"), F.concat_ws(" ", *[F.get(ws, s + j) for j in range(size)]).alias("said")))

        return F.concat(of(gram, window), *[of(n, n) for n in short])

    tried = found.select("doc_id", "text_hash", F.explode(_once(F.struct("ws", "prints"), lambda r: candidates(r["ws"], r["prints"]))).alias("w")).select("doc_id", "text_hash", "w.*")
    spans = _join_small(tried, windows, ["length", "said"], more=F.octet_length("said")).select("doc_id", "text_hash", "start", "length", "item_id")
    return spans, marked.select("doc_id", "text_hash", "n_words")


def _covered(spans: Column) -> Column:
    """The words that spans (start, length), ascending, cover together."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(a: Column, s: Column) -> Column:
        end = (s["start"] + s["length"]).cast("long")
        more = F.greatest(end - F.greatest(a["end"], s["start"].cast("long")), F.lit(0).cast("long"))
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + more).alias("n"))

    return F.aggregate(spans, zero, add)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """For each row of ``docs``: doc_id, text_hash, n_words, n_hit, n_items, items and contaminated.

    A word is hit if it lies in an occurrence of an item's window of ``window``
    words; an item of fewer words is one window. ``items`` are the ids, as
    strings in order, of items with an occurring window. Null or wordless texts
    have no words and are not contaminated; items without words or without an
    id hit nothing. Rows that repeat a document are judged alike; extra columns
    are left out; an empty table gives no rows and an empty benchmark no hits.
    """
    spans, rows = _hits(docs.select("doc_id", "text"), benchmark, window)
    per = spans.groupBy("doc_id", "text_hash").agg(
        _covered(F.array_sort(F.collect_set(F.struct("start", "length")))).alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    per = common.written(per, "hits").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "n_hit", "items")
    out = _join_small(rows, per, [rows["doc_id"].eqNullSafe(per["hit_id"]), rows["text_hash"] == per["hit_hash"]], "left", F.octet_length(F.array_join("items", ",")) + 8 * F.size("items"))
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs``, all columns, without the contaminated documents. Rows without an id stay unless hit."""
    bad = contamination(docs, benchmark, window).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    bad = common.written(bad, "contaminated")
    return _join_small(docs, bad, [docs["doc_id"].eqNullSafe(bad["bad_id"]), F.xxhash64(docs["text"]) == bad["bad_hash"]], "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, in windows of ten words."""
    found = contamination(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLE_SQL = {
    "op3_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce("text", ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS said
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0
), ns AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT d.doc_id, s, ns.n, array_to_string(w[s:s + ns.n - 1], ' ') AS said
  FROM d, ns, unnest(range(1, len(w) - ns.n + 2)) AS t(s) WHERE len(w) >= ns.n
), h AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.said = iw.said),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(s, s + n)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id"""
}
