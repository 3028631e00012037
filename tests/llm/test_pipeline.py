import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import common

from .test_decontaminate import brute as contamination
from .test_ngram_join import brute as components
from .test_substring_dedup import brute as dedup


@pytest.fixture(scope="module")
def folder(spark, words, tmp_path_factory):
    rng = random.Random(9)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = str(tmp_path_factory.mktemp("sf"))
    passage, item = make(60), make(20)
    texts = [f"{make(30)}\n{make(20)}" for _ in range(60)]
    texts += [f"{make(9)}\n{passage}\n{make(12)}" for _ in range(5)] + [texts[0]] * 3 + [f"{make(20)} {item[: len(item) // 2]} {make(4)}", f"{make(15)} {item} {make(5)}"]
    base = make(300).split(" ")
    for k in range(4):
        texts.append(" ".join(rng.choice(words) if i == 7 * k else x for i, x in enumerate(base)))
    toxic = [f"{make(25)} vile odious {make(5)} vile scorn {make(9)}" for _ in range(40)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*texts, *toxic, None, ""])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    labels = [(i, 1, int(len(texts) <= i < len(texts) + len(toxic))) for i in range(len(texts) + len(toxic))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        made = common.written(stage(spark, docs, folder), "stage")
        if name != "packing":
            assert made.columns == corpus_pipeline.COLUMNS
        kept[name] = (before, made)
        docs = made
    before, made = kept["toxicity"]
    left = {r["doc_id"] for r in made.collect()}
    toxic = {d for d, t in before.items() if t and "vile" in t}
    assert len(toxic & left) <= 2 and (set(before) - toxic) <= left
    before, made = kept["n-gram Jaccard join"]
    assert sorted(r["doc_id"] for r in made.collect()) == [d for d, _, c in components(sorted(before.items()), 5, 80) if d == c]
    before, made = kept["substring dedup"]
    want = dedup(list(before.items()), 13)
    assert {r["doc_id"]: r["text"] for r in made.collect()} == {d: want[d, t] for d, t in before.items()}
    assert made.where(F.char_length(F.coalesce("text", F.lit(""))) != F.col("n_chars")).isEmpty()
    before, made = kept["benchmark decontamination"]
    (item,) = (r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").collect())
    hit = {d for d, t in before.items() if contamination(t, [(1, item)], 10)[1]}
    assert hit and {r["doc_id"] for r in made.collect()} == set(before) - hit
    before, made = kept["packing"]
    assert {r["doc_id"] for r in made.collect()} == set(before)


def test_run(spark, folder):
    last = corpus_pipeline.run(spark, folder)
    assert last.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and last.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "packing"]


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, blank and long texts, and columns of the stages' own names."""
    shared = " ".join(f"word{i}" for i in range(60))
    long = "\n".join(f"line {i} " + " ".join(f"x{i}y{j}" for j in range(9)) for i in range(4000))
    rows = [(1, shared, "en", "a", 5), (1, shared, "en", "a", 5), (None, None, None, None, None), (2, None, None, "a", None), (3, "", "en", None, 0), (4, " \n\t", "en", "a", 3), (None, shared, None, None, None), (5, shared + " more", "en", "a", 7), (6, long, "en", "a", len(long)), (7, "a single fresh text of its own", "en", "a", 30)]
    clash = "1 AS score, 2 AS predicted, 3 AS component_id, 4 AS removed, 5 AS contaminated, 6 AS text_hash, 7 AS ids"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *clash.split(", "))
    spark.createDataFrame([(1, "nothing that occurs anywhere in these rows at all, not once"), (None, shared), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert near.columns == corpus_pipeline.COLUMNS
    assert sorted(str(r["doc_id"]) for r in near.collect()) == sorted(["1", "1", "None", "2", "3", "4", "None", "6", "7"])
    cut = corpus_pipeline.drop_repeated_passages(spark, docs, str(tmp_path))
    assert cut.columns == corpus_pipeline.COLUMNS
    got = [(r["doc_id"], r["text"]) for r in cut.collect()]
    # the null id ranks first; both rows of document 1 repeat its line
    assert sorted(map(str, got)) == sorted(map(str, [(1, ""), (1, ""), *[(d, t) for d, t, *_ in rows if d != 1]]))
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert clean.columns == corpus_pipeline.COLUMNS and clean.count() == len(rows)
    pieces = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    per = {}
    for p in pieces:
        per.setdefault(p["doc_id"], []).append(p["length"])
    assert per[3] == [1] and per[2] == [1] and len(per[1]) >= 2 and set(per) == {r[0] for r in rows}
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_repeated_passages, corpus_pipeline.drop_contaminated, corpus_pipeline.pack):
        assert stage(spark, docs.limit(0), str(tmp_path)).isEmpty()
