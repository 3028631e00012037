import math
import random
from collections import Counter

import pytest

from millrace.operators.overlap import ngram_scores, overlaps

WORDS = "find ( ) db . sort { } $gt : 1 name".split()


def grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def brute(pairs, keywords):
    """Both scores by counting."""
    weight = lambda g, on: 1.0 if not on or len(g) > 1 or g[0] in keywords else 0.2
    logs = ([], [])
    first = [0.0, 0.0]
    for n in range(1, 5):
        for kind in (0, 1):
            matched = total = 0.0
            for _, r, p in pairs:
                a, b = grams((r or "").split(), n), grams((p or "").split(), n)
                matched += sum(min(c, b[g]) * weight(g, kind) for g, c in a.items())
                total += max(1.0, sum(c * weight(g, kind) for g, c in (a if kind else b).items()))
            if n == 1:
                first[kind] = matched
            logs[kind].append(math.log((matched or 0.1) / total))
    size = [sum(len((x[i] or "").split()) for x in pairs) for i in (1, 2)]
    penalty = 0.0 if not size[1] else 1.0 if size[1] > size[0] else math.exp(1 - size[0] / size[1])
    return [penalty * math.exp(sum(x) / 4) if first[k] else 0.0 for k, x in enumerate(logs)]


@pytest.mark.parametrize("seed", range(3))
def test_scores(spark, seed):
    rng = random.Random(seed)
    make = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)) if n else rng.choice([None, "", "  "])
    pairs = [(i, r := make(rng.randrange(12)), r if rng.random() < 0.3 else make(rng.randrange(12))) for i in range(30)]
    pairs += [pairs[0], pairs[1], pairs[1], (2, "other text", "of one id")]
    df = spark.createDataFrame(pairs, "id long, reference string, prediction string")
    (row,) = ngram_scores(df, ["find", "sort", "$gt"]).collect()
    assert list(row) == pytest.approx(brute(pairs, {"find", "sort", "$gt"}))


def test_nothing_in_common(spark):
    df = spark.createDataFrame([(1, "a b", "c d"), (2, None, "")], "id long, reference string, prediction string")
    assert list(ngram_scores(df, ["a"]).first()) == [0.0, 0.0]
    assert list(ngram_scores(df.limit(0), ["a"]).first()) == [0.0, 0.0]
    assert {r["n"]: (r["matched"], r["predicted"], r["expected"]) for r in overlaps(df).collect()} == {1: (0, 3, 3), 2: (0, 2, 2), 3: (0, 2, 2), 4: (0, 2, 2)}


def test_ngrams_are_not_shuffled(spark):
    """A pair's n-grams are counted in its row: nothing is exploded or grouped by n-gram, and rows of one pair count each."""
    df = spark.createDataFrame([(1, "a b a b", "a b a")] * 3, "id long, reference string, prediction string")
    found = overlaps(df, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1
    assert {r["n"]: (r["matched"], r["predicted"], r["expected"]) for r in found.collect()} == {1: (9, 9, 12), 2: (6, 6, 9)}
