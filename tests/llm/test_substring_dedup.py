import random

import pytest

import corpus_pipeline
from millrace.llm import substring_dedup

from .conftest import ODD


def brute(rows, min_words):
    """What stays of each distinct (id, text), by rank order with a set of seen lines."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    seen, out = {}, {}
    for d, t in sorted(rows, key=key):
        if (d, t) in out:
            continue
        units = [(i, b" ".join(x.encode().lower().split())) for i, x in enumerate((t or "").split("\n"))]
        full = [(i, u) for i, u in units if u]
        old = []
        for n, (_, u) in enumerate(full):
            if u in seen:
                old.append(n)
            else:
                seen[u] = (d, n)
        gone, run = set(), []
        for n in [*range(len(full)), None]:
            if n in old:
                run.append(n)
            else:
                if sum(len(full[m][1].split()) for m in run) >= min_words:
                    gone |= {full[m][0] for m in run}
                run = []
        out[d, t] = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


@pytest.mark.parametrize("min_words", [13, 3, 1])
def test_against_brute_force(spark, words, min_words):
    rng = random.Random(min_words)
    pool = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 12, 13, 30, 80]))) for _ in range(60)]
    texts = ["\n".join(rng.choice([x, x.upper(), f"  {x}\t", ""]) for x in rng.choices(pool, k=rng.randint(0, 12))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate([*texts, *ODD, "\n".join(pool * 3)])] + [(3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame([(*r, "e", 7) for r in rows], "doc_id long, text string, removed string, line int").repartition(4)
    got = substring_dedup.dedup(df, min_words).collect()
    want = brute(rows, min_words)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, ((d, want[d, t]) for d, t in rows)))
    assert {r["line"] for r in got} == {7}


def test_offsets_and_kept_occurrence(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(2, f"é first\n{long}\nend"), (1, f"{long}"), (3, "clean text of its own")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.dedup(df).collect()}
    (span,) = got[2]["removed"]
    assert got[2]["text"] == "é first\nend" and f"é first\n{long}\nend"[span["start"] : span["end"]] == long
    assert (span["first_doc_id"], span["first_start"]) == (1, 0)
    assert got[1]["text"] == long and got[3]["text"] == "clean text of its own" and not got[3]["removed"]


def test_no_documents(none):
    assert substring_dedup.dedup(none).count() == 0


def test_null_ids_rank_first(docs):
    got = substring_dedup.dedup(docs[0]).collect()
    assert len(got) == len(docs[1])
    assert {r["text"] for r in got if r["doc_id"] is None} == {None, "no id"}


def test_short_lines_go_from_query_and_stage(spark, tmp_path):
    rows = [(1, "Short line\nalpha"), (2, "short  LINE\nbeta"), (3, "gamma\nshort line\ndelta\nalpha")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: "Short line\nalpha", 2: "beta", 3: "gamma\ndelta"}
    got = substring_dedup.op2_substring_dedup(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 1, 3: 2}
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept} == {d: (t, len(t)) for d, t in want.items()}


def test_passages_are_counted_where_they_stay_and_where_they_go(spark):
    half = [" ".join(f"{c}{i}" for i in range(30)) for c in "ab"]
    rows = [(1, "\n".join(["own", *half])), (2, f"{half[0].upper()}\n\n{half[1]}\nend"), (3, f"{half[0]}\nbetween\n{half[1]}"), (4, "a line\na line"), (5, None)]
    got = {r["doc_id"]: (r["n_passages"], r["n_passages_removed"], r["n_repeated"], len(r["removed"])) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 0, 2, 0), 2: (1, 1, 2, 2), 3: (0, 0, 2, 2), 4: (0, 0, 0, 1), 5: (0, 0, 0, 0)}
