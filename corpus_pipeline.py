"""A corpus through the training-data operators, stage by stage.

Every stage takes the documents that its predecessor kept, as (spark, docs,
sf_dir), and all but the last return the columns of ``documents``. A stage may
be written as Parquet and read again before the next.

Columns beyond those of ``documents`` do not reach the next stage, whatever their
names. An empty table gives an empty one. Texts are taken whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, decontaminate, ngram_join, packing, passages, substring_dedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and empty texts are scored as texts without words; rows that repeat a text get one score, so all or none of them go.
    """
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the five-word shingle join at 0.8 the document of the smallest id stays.

    Rows without words or without an id are linked with nothing and stay. Rows of the smallest id stay together, even if they repeat.
    """
    found = ngram_join.components(docs, 5, 80)
    gone = common.written(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    small = gone.count() <= ngram_join.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeating lines go, but for their first occurrence; n_chars follows the text.

    Null and empty texts stay as they are, and so does n_chars where nothing goes. The smallest doc_id has the first occurrence, null
    before all; rows that repeat an id and its text are one document.
    """
    cut = substring_dedup.dedup(docs)
    n = F.when(F.size("removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeating lines and passages of over 50 words go, but for their first occurrence; n_chars follows the text.

    A passage goes wherever it lies in its lines. Null and empty texts, ranks and rows that repeat a document are as in
    drop_repeated_passages, which takes whole lines alone.
    """
    cut = passages.dedup(docs)
    n = F.when(F.col("n_removed") + F.col("n_cut") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and wordless texts stay; rows that repeat a document are judged alike; an empty benchmark removes nothing.
    """
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark", "item_id", "text")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with the crc32 of their ids.

    A null or empty text has its end id alone; rows that repeat a document are packed each for itself.
    """
    pieces = packing.pack(docs, common.tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]
#: A trained model and the greedy packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
