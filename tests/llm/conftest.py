from __future__ import annotations

import random

import pytest

#: Parts of texts that are odd in one way or another.
ODD = [None, "", " ", "\n\n", "a", "Word", "É́ ÇA œuvre ß", "<|endoftext|> </s> [INST]", "tab\tand\x0bfeed\x0c", "x" * 5000, "0 1 2 3", "  ", "\U0001f600 smile"]


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def docs(spark, words):
    """Documents with copies, near copies, repeated lines, odd texts, repeated rows, null ids and clashing columns."""
    rng = random.Random(8)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [make(rng.randint(1, 120)) for _ in range(60)]
    base = make(150).split(" ")
    for k in range(25):  # near copies of differing distance
        near = list(base)
        for _ in range(k // 3):
            near[rng.randrange(len(near))] = rng.choice(words)
        texts.append(" ".join(near))
    line = make(30)
    texts += [f"{make(9)}\n{line}\n{make(5)}" for _ in range(6)] + [texts[3]] * 4 + [make(30_000)]
    rows = [(i, t) for i, t in enumerate(texts + ODD)]
    rows += [rows[5], rows[5], (5, "another text of the same id"), (None, "no id"), (None, None)]
    wide = [(d, t, 1.5, "x", [1], d) for d, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, score double, start string, ids array<int>, key long").repartition(3), rows


@pytest.fixture(scope="session")
def none(docs):
    return docs[0].limit(0)
