import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval, scoring
from millrace.sources import dumps, settings, sqlite
from millrace.sources.catalog import Catalog


@pytest.fixture
def root(tmp_path):
    (tmp_path / "zoo").mkdir()
    cats = [{"name": "Tom", "age": None, "kg": 3.5, "note": None}, {"name": "Io", "age": 4, "kg": 4, "note": None}, {"name": "A\n\"b\"", "age": 5, "kg": 2.0, "note": None, "tag": "7"}]
    (tmp_path / "zoo" / "cats.json").write_text(json.dumps(cats, indent=2))
    (tmp_path / "zoo" / "none.json").write_text("[]")
    (tmp_path / "zoo" / "list.json").write_text('[{"id": 1}]')
    return tmp_path


def test_dumps(spark, root):
    catalog = Catalog(spark)
    expected = {"zoo": ["cats", "none", "list.json", "gone"]}
    assert dumps.load_all(catalog, str(root), expected) == {"zoo": ["none", "gone"]}
    cats = catalog.collection("zoo", "cats").df
    assert [f.name for f in cats.schema] == ["_id", "name", "age", "kg", "note", "tag", "__has_tag", dumps.ORDINAL]
    assert [f.dataType.simpleString() for f in cats.schema][1:6] == ["string", "bigint", "double", "string", "string"]
    assert [r["name"] for r in cats.orderBy(dumps.ORDINAL).collect()] == ["Tom", "Io", 'A\n"b"']
    card = catalog.cards().where("collection = 'cats'").first()
    assert card["doc_count"] == 3 and "age (int, nullable), kg (float), note (unknown, nullable)" in card["text"]
    assert {r["collection"]: r["n"] for r in catalog.counts("zoo").collect()} == {"cats": 3, "list.json": 1}


def test_write_and_store(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    dumps.write_dump(df, str(tmp_path / "d"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "d")).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    for force, n in ((False, 2), (False, 4), (True, 2)):
        dumps.store(df, str(tmp_path / "p"), force)
        assert spark.read.parquet(str(tmp_path / "p")).count() == n


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "a.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE \"car-makers\" (id INTEGER PRIMARY KEY AUTOINCREMENT, name char(9), price float(10,2), raw)")
        db.executemany("INSERT INTO \"car-makers\" (name, price, raw) VALUES (?, ?, ?)", [("a", 1, 5), (None, 2.5, "t")])
        db.execute("CREATE TABLE bare (x TEXT)")
    assert sqlite.tables(path) == ["bare", "car-makers"]
    got = sqlite.read_table(spark, path, "car-makers")
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "a", 1.0, "5"), (2, None, 2.5, "t")]
    assert sqlite.read_table(spark, path, "bare").count() == 0
    with pytest.raises(FileNotFoundError):
        sqlite.tables(str(tmp_path / "gone.sqlite"))


def test_settings(spark, tmp_path):
    assert settings.parse_env("# c\nA=1\n B = 'x=y' \nno\n") == {"A": "1", "B": "x=y"}
    assert settings.mask_address("db+srv://me:pa:ss@host/x") == "db+srv://me:pa:***@host/x"
    assert settings.mask_address("db://host/x") == "db://host/x"
    df = spark.createDataFrame([("m", 1.5)], "Model string, Accuracy double")
    settings.write_scores(df, str(tmp_path / "s"))
    assert settings.read_scores(spark, str(tmp_path / "s"), "Model string, Accuracy double", "Accuracy").collect() == df.collect()


def test_split(spark):
    sizes = {"a": 74, "b": 67, "c": 61, "d": 50, "e": 30, "f": 23}
    rows = spark.createDataFrame([(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)], "id string, s string")
    split = retrieval.stratified_split(rows, "s")
    assert split.where("held_out").count() == 61 and split.count() == 305
    assert tuple(retrieval.leaks(split).first()) == (0, 0, 0)
    assert tuple(retrieval.leaks(split.union(split)).first())[0] == 0
    assert tuple(retrieval.leaks(split.union(split.withColumn("held_out", ~F.col("held_out")))).first())[0] == 305


def test_vote_and_prompts(spark):
    labels = ["A", "B", "B", "C", "C"]
    near = spark.createDataFrame([("q", i + 1, str(i), x, 1.0) for i, x in enumerate(labels)], "query_id string, rank int, id string, label string, score double")
    assert retrieval.vote(near, 5).first()["predicted"] == "A"  # a tie goes to the nearest, tied or not
    assert retrieval.vote(near, 3).first()["predicted"] == "B"
    assert {r["k"]: r["predicted"] for r in retrieval.vote_sweep(near, [1, 3, 5]).collect()} == {1: "A", 3: "B", 5: "A"}
    catalog = Catalog(spark)
    catalog.register("B", "t", spark.createDataFrame([(1, "x")], "a long, b string"))
    cases = spark.createDataFrame([("q", "how many?", "B", "easy")], "id string, question string, database string, complexity string")
    pool = spark.createDataFrame([(str(i), f"q{i}", f"db.x.find({i})") for i in range(5)], "id string, question string, normalized_query string")
    note = retrieval.numeric_note(catalog.cards(), {"B": ["t.b", "t.gone"], "C": ["u.x"]}, "\nStrings: {fields}\n")
    assert note == {"B": "\nStrings: t.b\n"}
    row = retrieval.prompts(cases, near, pool, catalog.cards(), "H\n", "R", note, k=3).first()
    assert row["database_match"] and row["retrieved_ids"] == ["0", "1", "2"]
    assert row["system_prompt"] == "H\nThe 3 most similar questions asked before, with their queries:\n\n1. Question: q0\nQuery: db.x.find(0)\n\n2. Question: q1\nQuery: db.x.find(1)\n\n3. Question: q2\nQuery: db.x.find(2)\n\nSchema of B, 1 collection(s):\n\n- t: { a (int), b (str) }\nStrings: t.b\n\nR"
    own = {"schema": "[{database}:{n}]", "examples": "<{n}>", "example": "{query} for {question}"}
    assert retrieval.prompts(cases, near, pool, catalog.cards(), "", "", k=1, wording=own).first()["system_prompt"] == "<1>db.x.find(0) for q0\n[A:0]\n"


def test_neighbours(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, None, 1), (5, [0.0, 0.0], 1)], "id long, vector array<float>, label int")
    got = retrieval.neighbours(rows.where("id = 1"), rows, 9).orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in got] == [(1, 1), (2, 2), (3, 3)]
    assert retrieval.neighbours(rows.where("id = 4"), rows, 3).count() == 0


def test_split_bounds_and_plan(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 3).alias("s"), F.lit(1).alias("held"))
    split = retrieval.stratified_split(rows, "s", fraction=0.3)
    want = {}
    for r in rows.select("s", "id", F.xxhash64("id", F.lit(42)).alias("h")).collect():
        want.setdefault(r["s"], []).append((r["h"], r["id"]))
    held = {}
    for r in split.where("held_out").collect():
        held.setdefault(r["s"], set()).add(r["id"])
    assert sum(map(len, held.values())) == 900
    for s, ids in held.items():
        assert ids == {i for _, i in sorted(want[s])[: len(ids)]}  # the first by hash
    assert retrieval.stratified_split(rows, "s", fraction=0.0).where("held_out").count() == 0
    assert retrieval.stratified_split(rows, "s", fraction=1.0).where("held_out").count() == 3000
    assert retrieval.stratified_split(rows.limit(0), "s").count() == 0
    many = retrieval.stratified_split(rows.union(rows), "s")  # rows of a key share a side
    assert many.groupBy("id").agg(F.count_distinct("held_out").alias("n")).where("n > 1").count() == 0


def test_neighbours_in_blocks_are_those_of_a_full_search(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, (300, 4)).astype(float)  # many ties, copies and zeros
    rows = spark.createDataFrame([(f"v{i:03}", [float(x) for x in v], "ab"[i % 2]) for i, v in enumerate(vectors)], "id string, vector array<float>, label string")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 20)
    monkeypatch.setattr(retrieval, "POOL_BLOCK", 37)
    monkeypatch.setattr(retrieval, "TILE", 8)
    got = {}
    for r in retrieval.neighbours(rows.where("id < 'v060'"), rows, 12).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["label"]))
    size = np.linalg.norm(vectors, axis=1)
    for i in range(60):
        ranked = sorted((-round(float(vectors[i] @ vectors[j] / size[i] / size[j]), 12), j) for j in range(300) if size[i] > 0 and size[j] > 0)
        assert got.get(f"v{i:03}", []) == [(f"v{j:03}", "ab"[j % 2]) for _, j in ranked[:12]]


def test_embed_and_generate(spark):
    import numpy as np

    def model(texts):
        return np.ones((len(texts), 3, 4)) * np.array([len(t) + 1 for t in texts])[:, None, None], np.array([[1, 1, 0]] * len(texts))

    rows = spark.createDataFrame([("ab",), (None,)], "q string")
    assert all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-6 for r in retrieval.embed(rows, "q", model).collect())

    def answer(p):
        if p == "bad":
            raise ValueError("no")
        return p.upper()

    got = retrieval.generate(spark.createDataFrame([(1, "x"), (2, "bad")], "id long, system_prompt string"), answer).orderBy("id").collect()
    assert [(r["generated_query"], r["error"]) for r in got] == [("X", None), (None, "no")]


def test_scores(spark):
    code = spark.createDataFrame([("m", 0.0003, 0.0003, 0.8162)], "Model string, ngram_match_score double, weighted_ngram_match_score double, syntax_match_score double")
    assert scoring.three_component_mean(code).first()["codebleu_3component"] == 0.2723
    records = spark.createDataFrame([(True, True, "PASS"), (None, False, "PASS"), (False, False, "FAIL")], "execution_accuracy boolean, non_empty_rate boolean, status string")
    assert tuple(scoring.summary(records).first()) == (33.33, 33.33, 66.67)
    assert tuple(scoring.summary(records.limit(0)).first()) == (0.0, 0.0, 0.0)
    found, lacking = scoring.slice_of(spark.createDataFrame([(1, "a")], "id long, t string"), spark.createDataFrame([("1",), ("2",)], "id string"))
    assert found.count() == 1 and [r["id"] for r in lacking.collect()] == ["2"]
    texts = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string")
    assert [r["id"] for r in scoring.paired(texts(3, 1), texts(1, 2, 3)).collect()] == ["1", "3"]
    one = lambda c: spark.createDataFrame([("m", 1.0)], f"Model string, {c} double")
    assert scoring.merged(one("a"), one("b"), one("c")).columns == ["Model", "a", "b", "c"]
