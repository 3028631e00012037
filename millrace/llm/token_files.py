"""Token-ID output (operator 1): Parquet files of token ids with page indexes.

A file holds one row per document, in ascending doc_id order over all files:
``doc_id``, ``part`` and ``part_start`` (which together place the document in
the whole token stream), ``n_tokens`` and ``ids`` (a list of integers). Small
row groups and pages with column and offset indexes let a reader fetch the
metadata columns alone, or the ids of a doc_id range alone. Ids below the
dictionary bound are dictionary encoded; doc_id and part_start, which ascend,
are delta encoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Parquet's writer settings: version 2 delta-encodes the integer columns without a dictionary.
FORMAT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#part_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}
ROWS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
ROWS_DDL = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode ``docs`` (doc_id, text) and write the token files to ``path``.

    Every whole text is encoded without special tokens and ``end_id`` appended.
    Null or empty texts are the end id alone. Rows that share a doc_id are
    ordered by text; a null doc_id comes first. Extra columns are left out. An
    empty table gives files without rows. The sort moves texts, not ids; texts
    are cut up nowhere, so a text must fit into a worker's memory.
    """

    @common.tidied
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = common.encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            for first, ends, ids in enc.batches(b.column(1)):
                n = np.diff(ends, prepend=0) + 1
                ids = np.insert(ids, ends, end_id).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield common.batch(ROWS, b.column(0).slice(first, len(n)), np.full(len(n), part, np.int32), start + offsets[:-1], n, lists)
                start += int(offsets[-1])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, ROWS_DDL).write.options(**FORMAT).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of token files, read from the metadata columns alone.

    ``start`` counts the ids of all documents before it. The sums of the parts
    are as many as the files' parts, not as the documents.
    """
    return _placed(spark.read.schema(ROWS_DDL).parquet(path), spark, path).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of token files; filters on doc_id reach the page index."""
    return _placed(spark.read.schema(ROWS_DDL).parquet(path), spark, path).select("doc_id", "start", "n_tokens", "ids")


def _placed(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    sums = spark.read.schema(ROWS_DDL).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row per written part: bounded by the number of shuffle partitions
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("part_start"))


def ids_crc32(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    @common.tidied
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            values, at = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B"), ids.offsets.to_numpy().astype(np.int64) * 4
            yield common.batch(schema, b.column(0), b.column(1), b.column(2), [zlib.crc32(values[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table, encoded, written, read back and digested."""
    path = common.shared_path(spark, "tokens")
    write_tokens(common.table(spark, sf_dir, "documents", "doc_id", "text"), path, common.tokenizer_path())
    return ids_crc32(read_tokens(spark, path))


QUERIES = {"op1_token_files": op1_token_files}
ORACLE_SQL: dict[str, str] = {}
