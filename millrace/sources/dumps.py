"""JSON dumps: one array of flat objects per collection, in a file or in files that continue each other."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import HAS
from ..session import stored
from .catalog import Catalog

#: The column that keeps the place of a document in its file.
ORDINAL = "__ordinal"


def _kind(x: object) -> T.DataType | None:
    match x:
        case bool():
            return T.BooleanType()
        case int():
            return T.LongType()
        case float():
            return T.DoubleType()
        case str():
            return T.StringType()
    return None


def file_name(collection: str) -> str:
    """A collection's file; a name that ends in .json is the file's own."""
    return collection if collection.endswith(".json") else f"{collection}.json"


def read_dump(spark: SparkSession, path: str, with_id: bool = True) -> DataFrame:
    """The documents of a dump in file order, with columns in document order and the ordinal column.

    Spark reads the file, so that any store will do. An array whose lines each
    hold whole documents, in one file or in files that continue each other, is
    parsed line by line in as many tasks as the file has splits, and its documents
    are stored in the shared folder once. Any other layout, such as an indented
    one, is parsed by one task a file, and a larger one should be loaded into Parquet
    once (see load()). The first document gives the order of the fields, and the
    first value that is not null a field's type; mixed whole numbers and floats
    are floats, other mixtures text. ``_id`` is a deterministic text per place.
    A field that some documents lack has a column beside it (HAS before its
    name) that tells which have it; a field that is null is there.
    """
    items = _by_lines(spark, path)
    if items is None:
        text = spark.read.text(path, wholetext=True)
        items = text.select(F.posexplode(F.from_json("value", "array<string>")).alias(ORDINAL, "doc"))
    sample = items.select(F.json_object_keys("doc").alias("k"), ORDINAL)
    first = sample.orderBy(ORDINAL).limit(1).collect()
    names = list(first[0]["k"]) if first else []
    # a row per field, not per document
    seen = {r["k"]: r["n"] for r in sample.select(F.explode(F.array_distinct("k")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()} if first else {}
    names += sorted(k for k in seen if k not in names)
    total = items.count() if first else 0
    # an entry per field, not per document
    wide = items.select(ORDINAL, F.from_json("doc", "map<string,string>").alias("m"), "doc")
    kinds: dict[str, T.DataType] = {}
    if names:
        raw = [F.regexp_extract("doc", rf'"{_escaped(n)}"\s*:\s*("|-?\d+[.eE]|-?\d|true|false|\[|\{{)', 1) for n in names]
        marks = wide.select(*[F.collect_set(r).alias(f"c{i}") for i, r in enumerate(raw)]).first()
        kinds = {n: _of_marks(set(marks[i]) - {""}) for i, n in enumerate(names)}
    columns = [F.col("m").getItem(n).cast(kinds[n]).alias(n) for n in names]
    columns += [F.array_contains(F.json_object_keys("doc"), n).alias(HAS + n) for n in names if seen[n] < total]
    own_id = [F.format_string("%024x", F.col(ORDINAL)).alias("_id")] if with_id and "_id" not in names else []
    return wide.select(*own_id, *columns, F.col(ORDINAL).cast("long").alias(ORDINAL))


def _by_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """Place and text of the documents of an array whose lines hold whole documents; None for any other layout.

    The lines' brackets and commas have to be those of one array of objects.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    text = spark.read.text(path).select(*place, F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("line"))
    head, tail = F.regexp_extract("line", r"^\[?\s*,?\s*", 0), F.regexp_extract("line", r"\s*,?\s*\]?$", 0)
    body = F.expr("substring(line, char_length(head) + 1, greatest(char_length(line) - char_length(head) - char_length(tail), 0))")
    parts = text.withColumn("head", head).withColumn("tail", tail).withColumn("body", body)
    docs = parts.withColumn("docs", F.when(F.col("body") != "", F.from_json(F.concat(F.lit("["), "body", F.lit("]")), "array<string>")))
    some = F.col("body") != ""
    whole = F.col("body").startswith("{") & F.col("body").endswith("}") & F.coalesce(F.forall("docs", lambda d: F.coalesce(d.startswith("{"), F.lit(False))), F.lit(False))
    has = lambda c, mark: F.col(c).contains(mark).cast("long")
    commas = F.when(some, has("head", ",") + has("tail", ",")).otherwise(F.greatest(has("head", ","), has("tail", ",")))
    opened, closed = F.col("line").startswith("[").cast("long"), F.col("line").endswith("]").cast("long")
    seen = docs.agg(F.sum(opened).alias("opened"), F.sum(closed).alias("closed"), F.sum(commas).alias("commas"), F.count_if(some).alias("full"), F.count_if(some & ~whole).alias("odd")).first()
    if (seen["opened"], seen["closed"], seen["odd"]) != (1, 1, 0) or seen["commas"] != max(seen["full"] - 1, 0):
        return None
    # numbered as they are stored: a split's documents follow each other
    found = stored(docs.select("file", "block", F.explode("docs").alias("doc")).withColumn("at", F.monotonically_increasing_id()))
    # one row per split of the files
    splits = found.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    before = Window.orderBy(F.length("file"), "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("base"))
    return found.join(F.broadcast(bases), ["file", "block"]).select((F.col("at") + F.col("base")).alias(ORDINAL), "doc")


def _escaped(name: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in name)


def _of_marks(marks: set[str]) -> T.DataType:
    if marks and all(m in ("true", "false") for m in marks):
        return T.BooleanType()
    if marks and all(m.lstrip("-")[:1].isdigit() for m in marks):
        return T.DoubleType() if any(m[-1] in ".eE" for m in marks) else T.LongType()
    return T.StringType()


def load(catalog: Catalog, database: str, name: str, path: str) -> bool:
    """Register the dump at ``path``; False if it is missing or empty."""
    from pyspark.errors import AnalysisException

    try:
        df = read_dump(catalog.spark, path)
    except AnalysisException:
        return False
    if df.isEmpty():
        return False
    catalog.register(database, name, df.select(*[c for c in df.columns if c != ORDINAL], F.col(ORDINAL)), [ORDINAL])
    return True


def write_dump(df: DataFrame, path: str, array: bool = False) -> None:
    """The rows as JSON lines, nulls kept; a table's dump in as many files as it has partitions.

    With ``array`` as one JSON array, a document a line: the files, in the order
    of their names, continue each other. read_dump() reads it.
    """
    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    if array:
        write_lines(lines, path)
    else:
        lines.write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Documents that are JSON texts already as one array; each partition is a file, and the files continue each other."""
    spark = lines.sparkSession
    texts = lines.rdd.map(lambda r: r[0])
    # a number for each partition; both jobs run on the same partitions
    full = texts.mapPartitionsWithIndex(lambda i, rows: [i for _ in islice(rows, 1)]).collect()
    first = min(full, default=0)

    def continued(i: int, rows: Iterator[str]) -> Iterator[tuple[str]]:
        for n, t in enumerate(rows):
            yield (("[" if i == first and n == 0 else ",") + t,)

    end = spark.sparkContext.parallelize([("]" if full else "[]",)], 1)
    made = texts.mapPartitionsWithIndex(continued).union(end)
    spark.createDataFrame(made, "value string", verifySchema=False).write.mode("overwrite").text(path)


def store(df: DataFrame, path: str, force: bool = False) -> None:
    """Documents into a collection's Parquet folder: added, or with ``force`` in place of what is there."""
    df.write.mode("overwrite" if force else "append").parquet(path)


def load_all(catalog: Catalog, root: str, expected: dict[str, list[str]], force: bool = False) -> dict[str, list[str]]:
    """Load the expected collections that are missing (with ``force`` all) from ``root``; what still lacks."""
    wanted = expected if force else catalog.verify(expected)
    for database, names in wanted.items():
        for name in names:
            load(catalog, database, name, f"{root}/{database}/{file_name(name)}")
    return catalog.verify(expected)
