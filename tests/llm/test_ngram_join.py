import random

import numpy as np
import pytest

from millrace.llm import common, ngram_join


def brute(rows, k, per_cent):
    def grams(t):
        ws = (t or "").encode().lower().split()
        return frozenset(tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))) if ws else frozenset()

    sets = [(d, grams(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= per_cent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted((d, len(s), find(d)) for d, s in sets)


@pytest.mark.parametrize(("k", "per_cent", "block"), [(3, 90, 1024), (3, 90, 4), (5, 80, 1024), (2, 80, 3)])
def test_against_brute_force(docs, monkeypatch, k, per_cent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    df, rows = docs
    got = ngram_join.components(df, k, per_cent).collect()
    assert len(got) == len(rows)
    known = [(d, t) for d, t in rows if d is not None]
    # rows of one id are one node: brute force sees each text under its id
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == brute(known, k, per_cent)
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


def test_far_near_copies(spark, words):
    """A large group whose members reach each other only over others."""
    rng = random.Random(2)
    base = [rng.choice(words) for _ in range(200)]
    rows = []
    for i in range(120):
        near = list(base)
        for _ in range(rng.randint(0, 9)):
            near[rng.randrange(200)] = f"w{rng.random()}"
        rows.append((i, " ".join(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.components(df, 3, 90).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 3, 90)


@pytest.mark.parametrize("per_cent", [90, 80])
def test_similar_sets_meet(per_cent):
    """Sets that are just similar enough share a key."""
    rng = np.random.default_rng(1)
    for n in [1, 2, 5, 9, 10, 11, 18, 19, 20, 50, 137, 400, 1500] * 12:
        one = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for other in (one, *[_changed(rng, one, per_cent) for _ in range(3)]):
            both = len(np.intersect1d(one, other))
            assert 100 * both >= per_cent * (len(one) + len(other) - both)
            assert np.intersect1d(ngram_join.signatures(one, per_cent), ngram_join.signatures(other, per_cent)).size


def _changed(rng, one, per_cent):
    """A set at the threshold: some of the n-grams taken out, others put in."""
    n = len(one)
    while True:
        out, new = rng.integers(0, n * (100 - per_cent) // 100 + 1), rng.integers(0, n * (100 - per_cent) // per_cent + 1)
        if 100 * (n - out) >= per_cent * (n + new) and n > out:
            return np.unique(np.concatenate([rng.permutation(one)[out:], rng.integers(0, 2**64, new, dtype=np.uint64)]))


def test_no_documents(none):
    assert ngram_join.components(none, 3, 90).count() == 0


def test_connect(spark):
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 5), (101, 100)]
    labels = spark.createDataFrame([(i, i) for i in [*range(60), 100, 101]], "id long, component long")
    with common.Scratch(spark) as tmp:
        got = {r["id"]: r["component"] for r in ngram_join.connect(labels, spark.createDataFrame(links, "a long, b long"), tmp).collect()}
    assert all(got[i] == i // 20 * 20 for i in range(60)) and got[100] == got[101] == 0


def test_rows_without_an_id_are_counted_and_not_linked(spark):
    text = "a b c d e f"
    df = spark.createDataFrame([(None, text), (None, text), (None, None), (4, text), (2, text)], "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(df, 3, 90).collect()]
    assert sorted(got, key=str) == sorted([(None, 4, None), (None, 4, None), (None, 0, None), (4, 4, 2), (2, 4, 2)], key=str)


def test_texts_that_share_an_id_are_linked_by_any_of_them(spark, words):
    rng = random.Random(12)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    one, two, three = make(60), make(60), make(60)
    near = lambda t: t.rsplit(" ", 1)[0] + " end"
    rows = [(9, one), (4, near(one)), (9, two), (7, near(two)), (7, two), (8, three), (3, near(three)), (3, None), (5, ""), (5, make(40)), (6, make(40)), (6, make(40)), (None, one)]
    for turn in range(2):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3 + turn)
        got = ngram_join.components(df, 3, 90).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == brute([r for r in rows if r[0] is not None], 3, 90)
        assert [(r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None] == [(58, None)]


def test_passages_that_most_documents_share(spark, words):
    rng = random.Random(13)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common_part = make(80)
    rows = [(i, f"{make(rng.randint(5, 60))} {common_part} {make(rng.randint(0, 9))}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for k, per_cent in ((5, 80), (2, 60)):
        got = ngram_join.components(df, k, per_cent).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, k, per_cent)


def test_a_key_of_all_documents_is_split(spark):
    """Rows of a key that every document has are counted and kept by several tasks."""
    narrow = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k, None) for k in narrow}
    for k, v in narrow.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 100_000, 1, 8).selectExpr("id", "explode(array(7L, 1000 + id)) AS key")
        with common.Scratch(spark) as tmp:
            got = ngram_join._of_several(rows, tmp)
            found = got.collect()
            plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(found) == 100_000 and {(r["key"], r["n"]) for r in found} == {(7, 100_000)}
    assert "skew=true" in plan and "Window" not in plan


def test_keys_meet_part_by_part(spark, words, monkeypatch):
    """No shuffle by key takes the keys of all parts, and the parts have every key once."""
    rng = random.Random(6)
    base = [[rng.choice(words) for _ in range(150)] for _ in range(8)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"w{rng.random()}" for w in base[i % 8])) for i in range(64)]
    taken, compared = [], []
    several, blocks = ngram_join._of_several, ngram_join._block_pairs

    def of_several(pairs, tmp):
        taken.append({r["key"] for r in pairs.collect()})
        return several(pairs, tmp)

    def block_pairs(met, marks, per_cent, pairs):
        if pairs:
            compared.append({r["key"] for r in met.collect()})
        return blocks(met, marks, per_cent, pairs)

    monkeypatch.setattr(ngram_join, "_of_several", of_several)
    monkeypatch.setattr(ngram_join, "_block_pairs", block_pairs)
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5, 80)
    keys = set().union(*taken)
    assert keys == {int(k) for _, t in rows for k in ngram_join.signatures(ngram_join.shingle_hashes(t, 5), 80).astype(np.int64)}
    assert sum(map(len, taken)) == len(keys) and max(map(len, taken)) < 0.3 * len(keys)
    assert len(compared) == 2 and not compared[0] & compared[1]
