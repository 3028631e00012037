from millrace import queries


def test_each_pipeline_runs_once(spark, monkeypatch):
    """Both comparisons read stored results, and no join or group of the pipelines again."""
    plans, match = [], queries.results.frames_match
    monkeypatch.setattr(queries.results, "frames_match", lambda a, b: plans.append(a._jdf.queryExecution().optimizedPlan().toString()) or match(a, b))
    assert [tuple(r) for r in queries.result_match_multiset(spark, "/root/testdata/sf0.001").collect()] == [(True, False)]
    assert len(plans) == 2 and not any("Join" in p or "Aggregate" in p for p in plans)
