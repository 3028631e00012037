import hashlib
import math
import random

import numpy as np
import pytest

from millrace.llm import centroids


def brute(vectors, k, rounds):
    """Plain Lloyd rounds with Python's numbers."""
    kept = [(i, [math.floor(4 * x) for x in v]) for i, v in vectors]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        cs = [[sum(col) // len(col) for col in zip(*mine, strict=True)] if (mine := [v for (_, v), o in zip(kept, own, strict=True) if o == j]) else c for j, c in enumerate(cs)]
    found = [(i, *near(v)) for i, v in kept]
    sums = [sum(d for _, d, j in found if j == c) for c in range(len(cs))]
    fit = lambda d: d if d < 2**63 else None
    whole = lambda c: fit(sums[c]) if all(d < 2**63 for _, d, j in found if j == c) else None
    total = fit(sum(sums)) if all(d < 2**63 for _, d, _ in found) else None
    return [(i, j, fit(d), whole(j), total, hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, d, j in found]


def check(spark, vectors, dims, k, rounds, parts=3):
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in vectors], "vec_id long, embedding array<double>, cluster int, id string").repartition(parts)
    got = centroids.cluster(centroids.scaled(df, "vec_id", "embedding", dims, 4), dims, k, rounds, "2:")
    key = lambda r: tuple((v is None, v) for v in r)
    fine = [(i, v) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute(fine, k, rounds), key=key)


@pytest.mark.parametrize("rows", [4096, 7])
def test_equal_to_plain_rounds(spark, monkeypatch, rows):
    """Many ties: few different whole components, copies, and odd rows of every kind."""
    monkeypatch.setattr(centroids, "ROWS", rows)
    rng = random.Random(5)
    vectors = [(i, [rng.choice([0.0, 0.25, 0.5, -0.25, rng.uniform(-3, 3)]) for _ in range(5)]) for i in range(300)]
    vectors += [(500 + i, vectors[3][1]) for i in range(90)] + [vectors[7]] * 3
    vectors += [(None, [1.0] * 5), (1, None), (2, []), (3, [1.0] * 6), (4, [1.0, None, 1.0, 1.0, 1.0]), (5, [math.nan] * 5), (6, [math.inf] + [0.0] * 4)]
    check(spark, vectors, 5, 17, 5)


def test_large_components_stay_exact(spark):
    rng = random.Random(6)
    vectors = [(i, [rng.choice([1e6, 3e9, -3e9, 1e30, 2.5, rng.uniform(-9, 9)]) for _ in range(3)]) for i in range(60)]
    vectors += [(100 + i, [rng.uniform(-9, 9) for _ in range(3)]) for i in range(60)]
    check(spark, vectors, 3, 9, 3)


def test_few_and_no_vectors(spark):
    check(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], 2, 5, 2, 1)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster(centroids.scaled(empty, "vec_id", "embedding", 2, 4), 2, 5, 2, "2:").count() == 0


def test_bounds_spare_distances():
    """After the first round few centroids are measured again, and the assignment is that of a full scan."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(2000, 16)) * 64 + 900 * rng.integers(0, 8, (2000, 1)))
    cs = [[int(v) for v in row] for row in x[:40]]
    state = centroids.Bounds.first(x, cs)
    share = []
    for turn in range(4):
        moved = [[v + (3 if (j + turn) % 3 == 0 else 0) for v in c] for j, c in enumerate(cs)]
        state.moved(np.array([centroids._far(a, b) for a, b in zip(cs, moved, strict=True)]))
        cs = moved
        share.append(state.assign(x, cs) / (len(x) * len(cs)))
        assert (state.kept[:, 0] == np.argmin(centroids.squared(x, cs), axis=1)).all()
    assert 0 < sum(share) / 4 < 0.5
