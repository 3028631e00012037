import math
import random

import pytest

from millrace.llm import topk


def brute(vectors, k, ask):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in whole:
        if ask(q):
            found = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in whole if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("candidates", "queries"), [(4096, 512), (16, 5)])
def test_exact(spark, monkeypatch, candidates, queries):
    monkeypatch.setattr(topk, "CANDIDATES", candidates)
    monkeypatch.setattr(topk, "QUERY_ROWS", queries)
    rng = random.Random(3)
    vectors = [(i, [rng.choice([0.0, 0.0, 0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(150)]
    vectors += [(200, None), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (240, [math.nan] + [0.0] * 5), (260, [math.inf] + [0.0] * 5), (280, []), (None, [1.0] * 6), (300, [0.0] * 6)] + [(400 + i, vectors[20][1]) for i in range(60)]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in vectors], "vec_id long, embedding array<double>, rank int, score string")
    rows = topk.whole_vectors(df, "vec_id", "embedding", 64)
    got = sorted(tuple(r) for r in topk.top_k(rows.where("id % 20 = 0"), rows, 20).collect())
    assert got == brute([(i, v) for i, v in vectors], 20, lambda i: i % 20 == 0)


def test_large_weights_and_few_rows(spark):
    rows = spark.createDataFrame([(0, [0, 7], [3_000_000_000, -5]), (1, [0], [2_000_000_000]), (2, [7], [1])], "id long, terms array<int>, weights array<long>")
    assert sorted(tuple(r) for r in topk.top_k(rows, rows, 5).collect())[:2] == [(0, 1, 1, 6_000_000_000_000_000_000), (0, 2, 2, -5)]
    assert topk.top_k(rows, rows, 5).count() == 6
    assert topk.top_k(rows, rows.limit(0), 5).count() == 0 and topk.top_k(rows.limit(0), rows, 5).count() == 0


def test_vectors_whose_scores_need_not_fit_take_no_part(spark):
    rows = [(0, [0.5, 1.0]), (20, [3e38, 1.0]), (1, [-3e38, -3e38]), (2, [float("inf"), 0.0]), (3, [2.0, 1e7]), (40, []), (4, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = topk.whole_vectors(df, "vec_id", "embedding", 64)
    assert sorted(r["id"] for r in made.collect()) == [0, 3, 40]
    got = topk.top_k(made.where("id % 20 = 0"), made, 20).collect()
    assert sorted((r["query_id"], r["id"], r["score"]) for r in got) == [(0, 3, 128 * 32 + 64 * 640_000_000), (0, 40, 0), (40, 0, 0), (40, 3, 0)]


def test_repeated_queries(spark):
    """A copy of a query changes nothing; another vector of its id has ranks of its own."""
    rng = random.Random(5)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    twice = [*vectors, vectors[20], vectors[20], (40, [0.5, 0.5, -0.5, 0.25])]
    df = spark.createDataFrame(twice, "vec_id long, embedding array<double>").repartition(3)
    rows = topk.whole_vectors(df, "vec_id", "embedding", 64)
    got = sorted(tuple(r) for r in topk.top_k(rows.where("id % 20 = 0"), rows, 20).collect())
    scaled = [(i, [math.floor(64 * x) for x in v]) for i, v in twice]
    want = []
    for q, qv in {(i, tuple(v)) for i, v in scaled if i % 20 == 0}:
        found = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in scaled if i != q)[:20]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    assert got == sorted(want) and sum(r[0] == 40 for r in got) == 40
