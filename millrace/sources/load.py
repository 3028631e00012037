"""``python -m millrace.sources.load``: whether the expected collections are there, and loading of those that are not.

Collections are folders of Parquet files, ``STORE/<database>/<collection>``;
dumps lie as ``DUMPS/<database>/<collection>.json``. What is expected is a JSON
object of databases and their collections.
"""

from __future__ import annotations

import argparse
import json
import logging
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from ..session import session
from .catalog import Catalog
from .dumps import ORDINAL, file_name, read_dump, store

log = logging.getLogger("millrace.load")


def opened(spark: SparkSession, folder: str, expected: dict[str, list[str]]) -> Catalog:
    """The expected collections that are in the store."""
    out = Catalog(spark)
    for database, names in expected.items():
        for name in names:
            try:
                df = spark.read.parquet(_place(folder, database, name))
            except AnalysisException:  # no such folder, or nothing in it
                continue
            out.register(database, name, df, [ORDINAL] if ORDINAL in df.columns else None)
    return out


def _place(folder: str, database: str, name: str) -> str:
    return f"{folder}/{quote(database, safe='')}/{quote(name, safe='')}"


def load_missing(spark: SparkSession, dumps: str, folder: str, expected: dict[str, list[str]], force: bool = False) -> dict[str, list[str]]:
    """Load the expected collections that lack (with ``force`` all, in place of what is there); what lacks then."""
    wanted = expected if force else opened(spark, folder, expected).verify(expected)
    for database, names in wanted.items():
        for name in names:
            try:
                df = read_dump(spark, f"{dumps}/{database}/{file_name(name)}")
            except AnalysisException:
                log.error("%s.%s: no dump", database, name)
                continue
            if df.isEmpty():
                log.error("%s.%s: an empty dump", database, name)
                continue
            store(df, _place(folder, database, name), force)
            log.info("%s.%s: loaded", database, name)
    return opened(spark, folder, expected).verify(expected)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all is there or nothing was to be loaded, 1 if something lacks after a load."""
    parser = argparse.ArgumentParser(prog="python -m millrace.sources.load", description=__doc__)
    parser.add_argument("dumps")
    parser.add_argument("store")
    parser.add_argument("expected", help="a JSON file")
    parser.add_argument("--load", action="store_true", help="load what lacks")
    parser.add_argument("--force", action="store_true", help="with --load: load everything again")
    asked = parser.parse_args(arguments)
    spark = spark or session()
    expected = json.loads("\n".join(r[0] for r in spark.read.text(asked.expected).collect()))
    lacking = opened(spark, asked.store, expected).verify(expected)
    if asked.load and (lacking or asked.force):
        lacking = load_missing(spark, asked.dumps, asked.store, expected, asked.force)
        for database, names in lacking.items():
            log.error("%s still lacks %s", database, ", ".join(names))
        return 1 if lacking else 0
    for database, names in lacking.items():
        log.warning("%s lacks %s", database, ", ".join(names))
    return 0


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(message)s")
    raise SystemExit(main())
