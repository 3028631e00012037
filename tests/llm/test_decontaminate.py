import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    ws, hit, found = split(text), set(), set()
    for item, said in items:
        iw = split(said)
        if item is None or not iw:
            continue
        n = min(window, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for s in range(len(ws) - n + 1):
            if tuple(ws[s : s + n]) in windows:
                hit |= set(range(s, s + n))
                found.add(str(item))
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize("window", [10, 13, 6, 3])
def test_against_brute_force(spark, docs, words, window):
    df, rows = docs
    rng = random.Random(window)
    texts = [t for _, t in rows if t and 30 < len(t) < 3000]
    items = []
    for i in range(40):
        src = split(rng.choice(texts))
        n = rng.choice([1, 2, 5, 9, 10, 11, 14, 25])
        at = rng.randrange(max(1, len(src) - n))
        items.append((i, " ".join([*src[at : at + n], *rng.sample(words, rng.choice([0, 0, 3]))]).title()))
    items += [(100, None), (101, ""), (102, "..."), (None, items[0][1]), (103, items[1][1]), (103, items[1][1])]
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, said string")
    got = decontaminate.contamination(df, bench, window).collect()
    want = sorted((d, *brute(t, items, window)) for d, t in rows if d is not None)
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got if r["doc_id"] is not None) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in got)
    kept = decontaminate.clean(df, bench, window)
    assert kept.columns == df.columns
    assert kept.count() == sum(not brute(t, items, window)[1] for _, t in rows)


def test_empty_sides(spark, docs, none):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    got = decontaminate.contamination(docs[0], bench.limit(0))
    assert got.count() == len(docs[1]) and got.where("contaminated").isEmpty()


def test_winnowing_guarantee(spark):
    """Texts that share ten words, wherever, share a fingerprint."""
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(10)]
    rows = [(i, " ".join([f"x{rng.random()}" for _ in range(rng.randint(0, 30))] + shared + [f"y{rng.random()}" for _ in range(rng.randint(0, 30))])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, "before " + " ".join(shared) + " after")], "item_id long, text string")
    got = decontaminate.contamination(df, bench).collect()
    assert all(r["n_hit"] == 10 and r["items"] == ["7"] for r in got)


def test_main_path_is_native(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    plan = decontaminate.contamination(docs[0], bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_long_text_full_of_hits(spark):
    """Fingerprints are dealt into lists, each word's gram is looked for in one of them; tables with long lists are not broadcast."""
    rng = random.Random(6)
    said = [f"w{rng.randrange(900)}" for _ in range(6000)]
    df = spark.createDataFrame([(1, " ".join(["first", *said, "last"])), (2, "nothing at all")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(said[i : i + 3000])) for i in range(0, 6000, 1500)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.contamination(df, bench).collect()}
    assert got == {1: (6002, 6000, 4), 2: (3, 0, 0)}


def test_broadcasts_are_bounded_in_bytes(spark, monkeypatch):
    left = spark.range(3)
    right = spark.createDataFrame([(1, "x" * 5000)], "id long, s string")
    plan = lambda: decontaminate._join_small(left, right, "id", more=F.octet_length("s"))._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan()
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 5000)
    assert "broadcast" not in plan()
