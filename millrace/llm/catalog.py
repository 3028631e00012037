"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat, decontaminate, html_wrappers, lexical, licenses, ngram_join, packing, passages, pieces, substring_dedup, token_files, topk, toxicity

_MODULES = (token_files, substring_dedup, passages, decontaminate, ngram_join, licenses, html_wrappers, packing, toxicity, chat, topk, pieces, lexical, centroids)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
