import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, c.total()) for d, c in counts if c]
    n, total = len(held), sum(m for _, _, m in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, length in held:
            m = 50 + 50 * length * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "block", "tile", "opened"), [(4 << 20, 256, 32, 192), (2000, 3, 2, 1), (300, 2, 1, 5)])
def test_exact(spark, docs, words, monkeypatch, shard, block, tile, opened):
    """Copies that tie, repeated rows and ids, null ids, odd texts, and items of every kind."""
    for name, value in (("SHARD", shard), ("QUERIES_A_BLOCK", block), ("TILE", tile), ("OPENED", opened)):
        monkeypatch.setattr(lexical, name, value)
    df, rows = docs
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(9)]
    items += [(9, None), (10, ""), (11, "?!"), (12, "nowhere"), (13, rows[3][1]), (13, rows[3][1]), (13, "É́ ça WORD"), (None, words[0] + " " + words[0].upper()), (14, rows[70][1])]
    asked = spark.createDataFrame([(i, t, "x", 1.0) for i, t in items], "item_id long, text string, query string, score double").repartition(2)
    got = sorted([tuple(r) for r in lexical.top_k(df, asked, 7).collect()], key=str)
    assert got == brute(rows, items, 7)


def test_empty_tables(spark, none):
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a c")], "doc_id long, text string")
    assert lexical.top_k(none, some, 5).count() == 0 and lexical.top_k(docs, some.limit(0), 5).count() == 0
    assert [tuple(r)[:3] for r in lexical.top_k(docs, some, 5).collect()] == [(1, 1, 1)]


def test_bounds_spare_nodes():
    """Few nodes are opened where few documents are good."""
    rng = np.random.default_rng(3)
    n, lists = 4096, 20
    docs = np.concatenate([np.sort(rng.choice(n, 900, replace=False)) for _ in range(lists)])
    impact = rng.integers(1, 300, len(docs)) + 900_000 * ((docs < 40) & (rng.random(len(docs)) < 0.8))
    owner = np.repeat(np.arange(lists), 900)
    order = np.lexsort((-impact, owner))
    docs, impact = docs[order], impact[order]
    tree, best = lexical.WaveletTree(docs, impact, n), lexical.Best(1, 5)
    ends = np.arange(1, lists + 1) * 900
    opened = lexical.search(tree, np.arange(n), np.zeros(n, bool), (np.zeros(lists, np.int64), np.full(lists, 3), ends - 900, ends), best)
    score = np.bincount(docs, 3 * impact, n).astype(np.int64)
    want = sorted((-s, d) for d, s in enumerate(score.tolist()) if s)[:5]
    assert [(-s, d) for s, d in zip(best.score.tolist(), best.id.tolist(), strict=True)] == want
    assert opened < 2 * n / 4
