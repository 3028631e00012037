import json
import math

import pytest
from pyspark.sql import functions as F

from millrace.operators.retrieval import neighbours
from millrace.operators.scoring import run_case
from millrace.plans.compiler import Compiler
from millrace.sources import dumps
from millrace.sources.catalog import Catalog
from millrace.sources.load import main

PEOPLE = [{"id": 1, "name": "Ann", "age": 3}, {"id": 2, "name": None, "age": 4}, {"id": 3, "age": 4, "pet": {"kind": "cat"}}, {"id": 4, "age": None, "name": "Bob", "zip": None}, {"id": 5}]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dump")
    (folder / "people.json").write_text(json.dumps(PEOPLE))
    made = Catalog(spark)
    assert dumps.load(made, "d", "people", f"{folder}/people.json")
    made.register("d", "more", spark.createDataFrame([(7, "x"), (3, None)], "id long, tag string"), ["id"])
    return made


@pytest.fixture(scope="module")
def run(shop):
    return lambda text, fuse=True: Compiler(shop, "d", fuse).compile(text).materialize()


def test_documents_lack_what_they_lacked(run):
    got = run("db.people.find({}, {'_id': 0})")
    assert [{k: v for k, v in r.items() if k != "pet"} for r in got] == [{k: v for k, v in p.items() if k != "pet"} for p in PEOPLE]
    assert [r["id"] for r in got if "pet" in r] == [3]


@pytest.mark.parametrize(
    ("where", "found"),
    [("{'name': {'$exists': True}}", [1, 2, 4]), ("{'name': {'$exists': False}}", [3, 5]), ("{'name': None}", [2, 3, 5]), ("{'name': {'$ne': None}}", [1, 4]), ("{'name': {'$ne': 'Ann'}}", [2, 3, 4, 5]), ("{'zip': {'$exists': True}}", [4]), ("{'name': {'$exists': True, '$eq': None}}", [2]), ("{'$nor': [{'age': {'$exists': True}}]}", [5])],
)
def test_exists_is_not_null(run, where, found):
    assert [r["id"] for r in run(f"db.people.find({where})")] == found


def test_presence_goes_through_stages(run):
    assert run("db.people.aggregate([{'$project': {'_id': 0, 'id': 1, 'n': '$name'}}, {'$match': {'n': {'$exists': False}}}])") == [{"id": 3}, {"id": 5}]
    assert run("db.people.aggregate([{'$addFields': {'n': '$name', 'age': 1}}, {'$match': {'n': {'$exists': True}, 'age': {'$exists': True}}}, {'$count': 'k'}])") == [{"k": 3}]
    assert run("db.people.aggregate([{'$group': {'_id': None, 'l': {'$push': '$name'}, 'n': {'$sum': 1}}}])") == [{"_id": None, "l": ["Ann", None, "Bob"], "n": 5}]
    (row,) = run("db.people.aggregate([{'$group': {'_id': None, 's': {'$addToSet': '$name'}, 'd': {'$push': {'i': '$id', 'n': '$name'}}}}])")
    assert sorted(row["s"], key=str) == ["Ann", "Bob", None] and row["d"] == [{"i": 1, "n": "Ann"}, {"i": 2, "n": None}, {"i": 3}, {"i": 4, "n": "Bob"}, {"i": 5}]
    got = run("db.people.aggregate([{'$group': {'_id': {'n': '$name'}, 'k': {'$sum': 1}}}])")
    assert sorted((str(r["_id"]), r["k"]) for r in got) == [("{'n': 'Ann'}", 1), ("{'n': 'Bob'}", 1), ("{'n': None}", 1), ("{}", 2)]
    assert {(r["_id"], r["k"]) for r in run("db.people.aggregate([{'$group': {'_id': '$name', 'k': {'$sum': 1}}}])")} == {("Ann", 1), ("Bob", 1), (None, 3)}
    got = run("db.people.aggregate([{'$group': {'_id': None, 'd': {'$push': '$$ROOT'}}}, {'$unwind': '$d'}, {'$replaceRoot': {'newRoot': '$d'}}, {'$match': {'name': {'$exists': False}}}, {'$project': {'_id': 0, 'id': 1, 'age': 1}}])")
    assert got == [{"id": 3, "age": 4}, {"id": 5}]
    assert set(run("db.people.distinct('name')")) == {"Ann", "Bob", None} and run("db.people.distinct('zip')") == [None]


@pytest.mark.parametrize("fuse", [True, False])
def test_lookups_of_ragged_documents(run, fuse):
    look = "{'$lookup': {'from': 'people', 'localField': 'id', 'foreignField': 'id', 'as': 'p'}}"
    got = run(f"db.more.aggregate([{look}, {{'$unwind': {{'path': '$p', 'preserveNullAndEmptyArrays': True}}}}, {{'$project': {{'_id': 0, 'id': 1, 'p.age': 1, 'p.name': 1, 'n': '$p.name'}}}}])", fuse)
    assert sorted(got, key=lambda r: r["id"]) == [{"id": 3, "p": {"age": 4}}, {"id": 7}]
    assert run(f"db.more.aggregate([{look}, {{'$match': {{'p.pet': {{'$exists': True}}}}}}, {{'$project': {{'_id': 0, 'id': 1}}}}])", fuse) == [{"id": 3}]


def test_unions_keep_to_their_fields(run):
    union = "{'$project': {'_id': 0, 'id': 1, 'name': 1}}, {'$unionWith': 'more'}"
    got = run(f"db.people.aggregate([{union}])")
    assert sorted(map(str, got)) == sorted(map(str, [{"id": 1, "name": "Ann"}, {"id": 2, "name": None}, {"id": 3}, {"id": 4, "name": "Bob"}, {"id": 5}, {"id": 3, "tag": None}, {"id": 7, "tag": "x"}]))
    assert run(f"db.people.aggregate([{union}, {{'$match': {{'tag': {{'$exists': True}}}}}}, {{'$count': 'n'}}])") == [{"n": 2}]


def test_dotted_fields_are_put_into_documents(run):
    got = run("db.people.aggregate([{'$match': {'id': {'$in': [1, 3]}}}, {'$addFields': {'pet.age': '$age', 'a.b.c': 1}}, {'$project': {'_id': 0, 'pet.age': 1, 'a': 1}}])")
    assert [r["a"] for r in got] == [{"b": {"c": 1}}] * 2
    assert [r["pet"]["age"] for r in got] == [3, 4]


def test_cards_follow_the_first_document(shop):
    card = {r["id"]: r for r in shop.cards().collect()}["d.people"]
    assert [(f["name"], f["type"]) for f in card["fields"]] == [("id", "int"), ("name", "str, nullable"), ("age", "int, nullable")]


def test_an_absent_inner_value_fails_the_case(shop):
    case = lambda q: {"id": 1, "database": "d", "normalized_query": q}
    failed = run_case(shop, case("db.people.find({'age': {'$gt': db.people.find_one({'id': 99})['age']}})"), {"1": []})
    assert failed["status"] == "FAIL" and "NoneType" in failed["error"] and failed["execution_accuracy"] is False
    failed = run_case(shop, case("db.people.find({'age': {'$gt': db.people.find({'id': 99})[0]['age']}})"))
    assert failed["status"] == "FAIL" and "no such item" in failed["error"]
    fine = run_case(shop, case("db.people.find({'age': {'$gt': db.people.find_one({'id': 1})['age']}}, {'_id': 0, 'id': 1})"))
    assert [r["id"] for r in fine["result"]] == [2, 3]


def test_array_dumps(spark, tmp_path):
    rows = [(1, 'a "b"\n', None), (2, None, 2.5)]
    df = spark.createDataFrame(rows, "i long, s string, w double").repartition(2)
    dumps.write_dump(df, str(tmp_path / "a"), array=True)
    back = dumps.read_dump(spark, str(tmp_path / "a"), with_id=False)
    assert sorted(tuple(r)[:3] for r in back.collect()) == rows
    dumps.write_dump(df.limit(0), str(tmp_path / "none"), array=True)
    assert json.loads("".join(f.read_text() for f in (tmp_path / "none").glob("part-*"))) == []


def test_load_command(spark, tmp_path):
    (tmp_path / "dumps" / "d").mkdir(parents=True)
    (tmp_path / "dumps" / "d" / "people.json").write_text(json.dumps(PEOPLE))
    (tmp_path / "want.json").write_text(json.dumps({"d": ["people", "gone.json"]}))
    arguments = [str(tmp_path / "dumps"), str(tmp_path / "store"), str(tmp_path / "want.json")]
    assert main(arguments, spark) == 0 and not (tmp_path / "store").exists()
    assert main([*arguments, "--load"], spark) == 1
    (tmp_path / "dumps" / "d" / "gone.json").write_text('[{"a": 1}]')
    assert main([*arguments, "--load"], spark) == 0 and main([*arguments, "--load", "--force"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "store" / "d" / "people")).count() == 5


def test_neighbours_of_odd_vectors(spark):
    pool = [(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [math.inf, 0.0], "c"), (4, [1.0, 0.0, 0.0], "d"), (5, [1.0], "e"), (6, [math.nan, 1.0], "f"), (7, [None, 1.0], "g"), (8, None, "h"), (9, [0.0, 0.0], "i"), (10, [0.0, 1.0], "j")]
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0]), (2, [0.0, math.inf])], "id long, vector array<double>")
    got = neighbours(queries, spark.createDataFrame(pool, "id long, vector array<double>, label string"), 2).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got) == [(0, 1, 1), (0, 2, 2), (1, 1, 5)]


def test_array_dumps_are_written_and_read_in_parts(spark, tmp_path):
    rows = [{"i": i, "s": f'x "{i}", [{{\n' * (i % 3)} for i in range(3000)]
    df = spark.createDataFrame([json.dumps(r) for r in rows], "string").coalesce(1).repartitionByRange(5, F.get_json_object("value", "$.i").cast("long"))
    dumps.write_lines(df.where(F.get_json_object("value", "$.i").cast("long") >= 1000), str(tmp_path / "a"))
    files = sorted((tmp_path / "a").glob("part-*"))
    assert len(files) > 2 and json.loads("".join(f.read_text() for f in files)) == rows[1000:]
    (tmp_path / "one.json").write_text("[" + ",\n ".join(map(json.dumps, rows)) + "\n]\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for path, want in (("a", rows[1000:]), ("one.json", rows)):
            back = dumps.read_dump(spark, str(tmp_path / path))
            assert back.rdd.getNumPartitions() > 1
            assert [(r[dumps.ORDINAL], r["_id"], {"i": r["i"], "s": r["s"]}) for r in back.orderBy(dumps.ORDINAL).collect()] == [(n, f"{n:024x}", r) for n, r in enumerate(want)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.mark.parametrize("text", ['[{"a": 1, "k": [\n{"a": 2},\n{"a": 3}\n]}, {"a": 4}]', '[{"a": 1}\n,\n{"a": 4}, {"a": 5}]', '[\n\n{"a": 1},{"a": 4}\n ,{"a": 5}\n]', '[\n  {\n  "a": 1\n  },\n  {"a": 4}]'])
def test_layouts_of_arrays(spark, tmp_path, text):
    (tmp_path / "d.json").write_text(text)
    assert [r["a"] for r in dumps.read_dump(spark, str(tmp_path / "d.json")).orderBy(dumps.ORDINAL).collect()] == [d["a"] for d in json.loads(text)]
