"""Running cases against gold results, and what comes of many runs."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import Compiler
from ..plans.frontend import check, normalize, strip_fences
from ..sources.catalog import Catalog
from .results import frames_match, is_empty, json_safe, results_match, scored_value


def run_case(catalog: Catalog, case: dict, gold: dict[str, Any] | None = None) -> dict:
    """The record of a case: PASS with its result, FAIL with the error, or SKIPPED without a database.

    ``gold`` maps ids as text to results; without it nothing is compared. A case
    that gold lacks has no accuracy, which counts as not correct.
    """
    record = {"id": case["id"], "question": case.get("question"), "database": case.get("database"), "query": case["normalized_query"]}
    if not case.get("database"):
        return record | {"status": "SKIPPED", "reason": "no database field"}
    try:
        result = json_safe(scored_value(Compiler(catalog, case["database"]).compile(case["normalized_query"])))
    except Exception as e:  # noqa: BLE001  whatever goes wrong is the case's result
        failed = {"status": "FAIL", "error": str(e)}
        return record | failed | ({"non_empty_rate": False, "execution_accuracy": False} if gold is not None else {})
    record |= {"status": "PASS", "result": result}
    if gold is None:
        return record
    known = str(case["id"]) in gold
    return record | {"non_empty_rate": not is_empty(result), "execution_accuracy": results_match(result, gold[str(case["id"])]) if known else None}


def run_cases(catalog: Catalog, cases: Iterable[dict], gold_records: Iterable[dict]) -> list[dict]:
    """The records of all cases, compared with those gold records that passed."""
    gold = {str(r["id"]): r["result"] for r in gold_records if r.get("status") == "PASS"}
    return [run_case(catalog, c, gold) for c in cases]


def build_gold(catalog: Catalog, cases: Iterable[dict]) -> tuple[list[dict], list[str], list[str], int]:
    """Gold records, ids with empty results, ids that failed, and how many are fine; skipped ones count as fine."""
    records = [run_case(catalog, c) for c in cases]
    empty = [str(r["id"]) for r in records if r["status"] == "PASS" and is_empty(r["result"])]
    failed = [str(r["id"]) for r in records if r["status"] == "FAIL"]
    return records, empty, failed, len(records) - len(empty) - len(failed)


def run_in_cluster(catalog: Catalog, cases: Iterable[dict], gold: dict[str, str], sample: int = 20) -> list[dict]:
    """The records of cases whose results may be large: what the driver gets of each is a number and a sample.

    ``gold`` maps ids as text to the queries whose results are right. Rows are
    counted and compared in the cluster, as multisets, null equal to null;
    fields may come in any order. A record has the size of the result, whether
    it is the gold one's (None without one), and at most ``sample`` of its rows;
    numbers, and single documents by the names of their fields, are compared as
    run_case() does. A gold query that fails is none.
    """
    out = []
    for case in cases:
        record = {"id": case["id"], "database": case.get("database"), "query": case["normalized_query"]}
        if not case.get("database"):
            out.append(record | {"status": "SKIPPED", "reason": "no database field"})
            continue
        compiler = Compiler(catalog, case["database"])
        try:
            made = compiler.compile(case["normalized_query"])
            many = made.kind in ("cursor", "values")
            value = None if many else json_safe(scored_value(made))
            size = made.dataframe().count() if many else None
            shown = json_safe([r.asDict(recursive=True) for r in made.dataframe().limit(sample).collect()]) if many else value
        except Exception as e:  # noqa: BLE001  whatever goes wrong is the case's result
            out.append(record | {"status": "FAIL", "error": str(e), "size": None, "non_empty_rate": False, "execution_accuracy": False})
            continue
        right = None
        if (query := gold.get(str(case["id"]))) is not None:
            try:
                wanted = compiler.compile(query)
                if many != (wanted.kind in ("cursor", "values")):
                    right = False
                elif many:
                    right = frames_match(made.dataframe(), wanted.dataframe())
                else:
                    right = results_match(value, json_safe(scored_value(wanted)))
            except Exception:  # noqa: BLE001  as if there were none
                right = None
        out.append(record | {"status": "PASS", "size": size, "result": shown, "non_empty_rate": size > 0 if many else not is_empty(value), "execution_accuracy": right})
    return out


def normalized(cases: DataFrame, column: str = "generated_query") -> DataFrame:
    """``cases``, all columns, with normalized_query, notes on what was rewritten, and the reason of a refusal ("" if none).

    A null text counts as an empty one; columns of the new names are replaced.
    """
    kind = T.StructType([T.StructField("normalized_query", T.StringType()), T.StructField("notes", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType())])

    def rewrite(texts: pd.Series) -> pd.DataFrame:
        made = [normalize(strip_fences(t or "")) for t in texts]
        return pd.DataFrame({"normalized_query": [t for t, _ in made], "notes": [n for _, n in made], "reason": [check(t) for t, _ in made]})

    made = cases.drop(*kind.names).withColumn("__made", F.pandas_udf(rewrite, kind)(F.col(column)))
    return made.select("*", "__made.*").drop("__made")


def per_cent(test: Column) -> Column:
    """The share of rows for which a test is true, in per cent to two places; null and false count as not."""
    return F.round(100 * F.count_if(test.eqNullSafe(True)) / F.greatest(F.count(F.lit(1)), F.lit(1)), 2)


def summary(records: DataFrame) -> DataFrame:
    """Accuracy, NonEmptyRate and RanOK of records (status, non_empty_rate, execution_accuracy)."""
    return records.agg(per_cent(F.col("execution_accuracy")).alias("Accuracy"), per_cent(F.col("non_empty_rate")).alias("NonEmptyRate"), per_cent(F.col("status") == "PASS").alias("RanOK"))


def arm_summary(records: DataFrame) -> DataFrame:
    """Arm, Correct, Total, Accuracy and the worst-case standard error in points."""
    n = F.count(F.lit(1))
    return records.groupBy("Arm").agg(F.count_if(F.col("execution_accuracy").eqNullSafe(True)).alias("Correct"), n.alias("Total"), per_cent(F.col("execution_accuracy")).alias("Accuracy"), F.round(F.sqrt(0.25 / n) * 100, 4).alias("StandardError"))


def slice_of(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose id, as text, is in ``ids``, and the ids that no row has."""
    wanted = ids.select(F.col("id").cast("string").alias("__id")).distinct()
    own = F.col("id").cast("string")
    return rows.join(wanted, own == F.col("__id"), "left_semi"), wanted.join(rows.select(own.alias("__id")), "__id", "left_anti").withColumnRenamed("__id", "id")


def paired(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """Reference and predicted texts of the ids that both have, in order of id."""
    a = reference.select(F.col("id").cast("string").alias("id"), F.col("text").alias("reference"))
    b = predicted.select(F.col("id").cast("string").alias("id"), F.col("text").alias("prediction"))
    return a.join(b, "id").orderBy("id")


def three_component_mean(scores: DataFrame) -> DataFrame:
    """CodeBLEU rows with the mean of n-gram, weighted n-gram and syntax match; data flow is left out, as 0 counts as 1 there."""
    parts = [F.col(f"{c}_match_score") for c in ("ngram", "weighted_ngram", "syntax")]
    return scores.withColumn("codebleu_3component", F.round((parts[0] + parts[1] + parts[2]) / 3, 4))


def group_means(scores: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The mean of each column by group, to four places."""
    return scores.groupBy(key).agg(*[F.round(F.avg(c), 4).alias(c) for c in columns])


def merged(execution: DataFrame, codebleu: DataFrame, bertscore: DataFrame) -> DataFrame:
    """The three score tables of the models that all have."""
    return execution.join(codebleu, "Model").join(bertscore, "Model")
