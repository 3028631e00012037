import sys

import __spark_entry__ as entry


def test_queries_have_sql():
    assert len(entry.queries()) > 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_training_data_queries(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # as if it were deleted
    names = set(entry.queries())
    assert "find_filter_project" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names
    assert set(entry.oracle_sql()) == names


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
