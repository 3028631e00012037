import hashlib
import random

import numpy as np
import pytest
import zstandard

from millrace.llm import common, pieces

PATH = common.tokenizer_path(pieces.MODEL)


@pytest.fixture(scope="module")
def lib():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def expected(lib, text):
    ids = [*lib.encode(text or ""), lib.eos_id()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))


def test_whole_documents(spark, lib, docs, monkeypatch):
    df, rows = docs
    want = sorted([(d, *expected(lib, t)) for d, t in rows], key=str)
    for size in (pieces.BLOCK, 3000):
        monkeypatch.setattr(pieces, "BLOCK", size)
        assert sorted([tuple(r) for r in pieces.digests(df, PATH).collect()], key=str) == want
    got = pieces.encode(df, PATH).collect()
    assert sorted([(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in got], key=str) == sorted([(d, ids := [*lib.encode(t or ""), lib.eos_id()], lib.decode(ids)) for d, t in rows], key=str)


def test_no_rows(spark, none):
    assert pieces.digests(none, PATH).count() == 0


def test_chunks_are_segmented_as_in_the_whole_text(lib):
    """Random texts of marks, blanks, line ends, controls, digits and letters of many scripts."""
    made, rng = pieces.model(PATH), random.Random(2)
    assert made.by_chunks
    alphabet = [" ", "  ", "   ", "▁", "\n", "\n\n", "\t", "\r\n", "\0", " ", "　", "the", " of", "ing", "12", "7", "é", "é", "ß", "語", "\U0001f600", "<s>", "</s>", "<0x0A>", "<unk>", ".", ",", "ﬁ", "​", "عر"]
    for text in ["", " ", "▁", "\n", " \n", "\n ", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000))]:
        chunks = made.chunks(text)
        assert [i for ids in (made.segment(chunks) if chunks else []) for i in ids] == lib.encode(text), repr(text)


def test_each_chunk_has_one_part(spark, monkeypatch):
    """Blocks ask for chunks again and again, each in the one part of the table that segments it."""
    monkeypatch.setattr(pieces, "BLOCK", 100)
    docs = spark.createDataFrame([(i, f"all these words and {i % 7} more\nlines") for i in range(60)], "doc_id long, text string").repartition(4)
    made = pieces.model(PATH)
    distinct = {c for i in range(60) for c in made.chunks(f"all these words and {i % 7} more\nlines")}
    blocks = pieces._blocks(docs, PATH, 4)
    asked = blocks.selectExpr("block", "explode(parts) p").select("block", "p.*")
    per_part = {}
    n = 0
    for r in asked.collect():
        ends = np.cumsum(common.unpacked_numbers(r["lengths"])).tolist()
        n += len(ends)
        for i, j in zip([0, *ends[:-1]], ends, strict=True):
            per_part.setdefault(zstandard.decompress(r["chunks"])[i:j].decode(), set()).add(r["part"])
    assert n > 3 * len(distinct)  # the blocks ask again and again
    assert set(per_part) == distinct and all(len(p) == 1 for p in per_part.values())


def test_models_that_may_not_be_cut(spark, lib, docs, monkeypatch):
    """Whole texts are then the chunks."""
    monkeypatch.setattr(pieces.Model, "_fits", lambda self: False)
    made = pieces.Model(PATH)
    assert made.chunks("a  b") == ["a  b"] and made.segment(["a  b"]) == [lib.encode("a  b")]


def test_blocks_stay_where_they_are(spark, docs):
    """The blocks are read by bucket: only chunks and their ids are shuffled."""
    spark.sql("SET spark.sql.adaptive.enabled = false")
    try:
        seen, plain = [], common.written

        def told(df, name):
            seen.append(df._jdf.queryExecution().executedPlan().toString())
            return plain(df, name)

        with pytest.MonkeyPatch.context() as m:
            m.setattr(common, "written", told)
            pieces.digests(docs[0], PATH)
        assert seen[0].count("Exchange hashpartitioning") == 2 and "Bucketed: true" in seen[0]
    finally:
        spark.sql("SET spark.sql.adaptive.enabled = true")
