"""Settings: environment files and addresses fit for logs. Score tables as CSV."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def parse_env(text: str) -> dict[str, str]:
    """KEY=VALUE lines; comments and lines without = are left out, quotes around a value dropped."""
    out = {}
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith("#") and "=" in line:
            key, _, value = line.partition("=")
            out[key.strip()] = value.strip().strip("\"'")
    return out


def mask_address(address: str) -> str:
    """An address whose password, if it has one, is hidden."""
    return re.sub(r"^([^@]*//[^@]*|[^@/]*):[^:@]*@", r"\1:***@", address, count=1)


def write_scores(df: DataFrame, path: str) -> None:
    """A table of scores, a few rows, as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_scores(spark: SparkSession, path: str, schema: str, needed: str) -> DataFrame:
    """Score rows; lines of free text after the table, which lack the column ``needed``, are left out."""
    return spark.read.option("header", True).schema(schema).csv(path).where(f"`{needed}` IS NOT NULL")
