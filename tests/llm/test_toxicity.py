import random
import zlib

import pytest

from millrace.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark, words):
    rng = random.Random(6)
    bad = ["vile", "scorn", "nasty", "odious", "mean"]
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.2
        ws = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(2, 5) if toxic else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        rows.append((i, " ".join(ws), 9.9, "old"))
        labels.append((i, int(toxic)))
    extra = [(None, 1), (5, None), (99_999, 1), *labels[:3]]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string"), spark.createDataFrame(labels + extra, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(labelled):
    docs, labels, truth = labelled
    model = toxicity.train(docs, labels)
    assert 0 < len(model[0]) < 1 << toxicity.BITS and len(model[0]) == len(model[1])
    got = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out(docs["doc_id"])).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert len(held) > 200 and right / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_labels_of_held_out_documents_are_not_used(labelled):
    docs, labels, _ = labelled
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[2] == b[2]


def test_odd_texts_and_no_labels(spark, docs, none):
    df, rows = docs
    model = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [len(x) for x in model[:2]] == [0, 0]
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) and all(r["score"] == 0.5 and r["predicted"] == 0 for r in got)
    assert toxicity.score(none, model).count() == 0


def test_update_is_the_published_one():
    """One coordinate against the formula, step by step."""
    m = toxicity.Ftrl(alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z = n = 0.0
    bz = bn = 0.0
    import math

    import numpy as np

    for y in (1, 0, 1, 1, 0):
        w = 0.0 if abs(z) <= 0.1 else (math.copysign(0.1, z) - z) / ((1 + n**0.5) / 0.5 + 0.2)
        b = -bz / ((1 + bn**0.5) / 0.5 + 0.2)
        g = 1 / (1 + math.exp(-(w + b))) - y
        z += g - ((n + g * g) ** 0.5 - n**0.5) / 0.5 * w
        bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / 0.5 * b
        n, bn = n + g * g, bn + g * g
        m.learn(np.array([3]), y)
        assert math.isclose(m.z[3], z) and math.isclose(m.n[3], n) and math.isclose(m.bias_z, bz)


def test_features():
    assert len(toxicity.features(None)) == len(toxicity.features("...")) == 0
    a = toxicity.features("One two three four")
    assert len(a) == 4 + 3 + 2 and (a == toxicity.features("one TWO, three; four!")).all()
    assert len(toxicity.features("abcdefgh")) == 2  # the word and its stem
