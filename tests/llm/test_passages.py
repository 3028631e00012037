import random

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from millrace.llm import passages

from .conftest import ODD

W = passages.WINDOW


def brute(rows):
    """The words that stay of each distinct (id, text): no later line, no word of a later window."""
    seen_lines, seen, out = set(), {}, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if (d, t) in out:
            continue
        lines = [x for x in ([w.decode() for w in x.encode().lower().split()] for x in (t or "").split("\n")) if x]
        gone, at = set(), 0
        for line in lines:
            if tuple(line) in seen_lines:
                gone |= set(range(at, at + len(line)))
            seen_lines.add(tuple(line))
            at += len(line)
        words = [w for line in lines for w in line]
        for i in range(len(words) - W + 1):
            first = seen.setdefault(tuple(words[i : i + W]), (d, t, i))
            if first[:2] != (d, t) or i >= first[2] + W:
                gone |= set(range(i, i + W))
        out[d, t] = [w for i, w in enumerate(words) if i not in gone]
    return out


def test_against_brute_force(spark, words):
    rng = random.Random(4)
    make = lambda n: [rng.choice(words) for _ in range(n)]
    pool = [make(n) for n in (50, 51, 52, 60, 75, 76, 77, 130, 200)]
    texts = []
    for _ in range(60):
        parts = []
        for p in rng.choices(pool, k=rng.randint(0, 4)):
            a = rng.choice([0, 0, 1, 7])
            parts += make(rng.choice([0, 1, 5])) + [rng.choice([w, w.upper()]) for w in p[a:]]
        texts.append("".join(w + rng.choice([" "] * 15 + ["\n", "\t ", " \n\n"]) for w in parts))
    texts += [*ODD, " ".join(["ha"] * 300), " ".join(["ha", "ho", "hi"] * 60), texts[5], None]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[7])]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, n_cut string").repartition(4)
    got = passages.dedup(df).collect()
    want = brute(rows)
    stays = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    assert sorted(map(str, ((r["doc_id"], stays(r["text"])) for r in got))) == sorted(map(str, ((d, want[d, t]) for d, t in rows)))
    assert sum(r["n_cut"] for r in got) > 1000
    assert [r for r in got if r["text"] is None and r["doc_id"] == len(texts) - 1]


def test_a_passage_inside_a_line_goes_from_the_stage(spark):
    passage = " ".join(f"W{i}" for i in range(51))
    short = " ".join(f"s{i}" for i in range(50))
    texts = [f"own  head\n x {passage} tail", f"  a\t{passage.lower()}  b c\nd", f"e f {passage}\n\ng", f"{passage.replace(' ', chr(10), 3)} h", f"i {short} j", f"k {short} l", "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["substring dedup"]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stage(spark, docs, "").collect()}
    want = [texts[0], "  a  b c\nd", "e f\n\ng", "h", *texts[4:]]
    assert got == {i: (t, len(t or "")) for i, t in enumerate(want)}


def test_no_documents(none):
    assert passages.dedup(none).count() == 0


@pytest.mark.parametrize("size", [4 << 20, 300])
def test_windows_of_slices(monkeypatch, words, size):
    monkeypatch.setattr(passages.common, "SLICE", size)
    rng = random.Random(6)
    texts = [*ODD, *[rng.choice(["", "\n", " "]) + " ".join(rng.choice(words) for _ in range(n)) for n in (50, 51, 52, 130, 3, 400, 51)], None]
    stays = [t and t.encode().lower().split() for t in texts]
    got = [(of, start, seen[at : at + W].tobytes()) for seen, _, ats, ofs, starts in passages._windows(pa.array(texts)) for at, of, start in zip(ats, ofs, starts, strict=True)]
    want = [(i, k, b" ".join(x[k : k + W])) for i, x in enumerate(stays) if x for k in range(len(x) - W + 1)]
    assert [g[:2] for g in got] == [w[:2] for w in want] and len({g[2] for g in got}) == len({w[2] for w in want}) == len({(g[2], w[2]) for g, w in zip(got, want, strict=True)})


def test_passages_inside_lines_go_from_a_registered_query(spark, tmp_path, words):
    passage = " ".join(f"W{i}" for i in range(51))
    short = " ".join(f"s{i}" for i in range(50))
    rng = random.Random(5)
    some = " ".join(rng.choice(words) for _ in range(150))
    texts = [f" own head {passage}\ttail ", f"a\n\tb {passage.lower()}  c \n\nd", f"{passage}\ne {passage} f", f"g {short}", f"h {short}", "a", "", None, f"{some} i", f"j\n{some}\x0b\n a", " \n\r"]
    texts += [" ".join(["ha"] * 300), "É\x1c\xa0ß " * 40, "É\x1c\xa0ß\u2003 " * 52 + passage]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = entry.queries()["op2_repeated_passages"](spark, str(tmp_path))
    got = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    assert {i: got[i] for i in range(11)} == {
        0: (0, 0, 0, texts[0]), 1: (1, 0, 51, "a\n\tb  c \n\nd"), 2: (2, 0, 102, "e f"), 3: (0, 0, 0, texts[3]), 4: (0, 0, 0, texts[4]), 5: (0, 1, 0, ""),
        6: (0, 0, 0, ""), 7: (0, 0, 0, None), 8: (0, 0, 0, texts[8]), 9: (1, 1, 150, "j"), 10: (0, 0, 0, texts[10]),
    }
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        found = db.sql(entry.oracle_sql()["op2_repeated_passages"])
        assert found.columns == out.columns and sorted(found.fetchall(), key=str) == sorted(map(tuple, out.collect()), key=str)
