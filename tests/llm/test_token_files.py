import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer
from tokenizers.processors import TemplateProcessing

from millrace.llm import common, token_files

from .conftest import ODD


@pytest.fixture(scope="module")
def whole():
    made = Tokenizer.from_file(common.tokenizer_path())
    return lambda t: made.encode(t or "", add_special_tokens=False).ids


def test_encoder_is_the_library(whole, words, monkeypatch):
    monkeypatch.setattr(common, "SLICE", 300)
    enc = common.read_encoder(common.tokenizer_path(), limit=20)
    assert isinstance(enc, common.WordEncoder)
    texts = [t for t in ODD if t] + ["It's 12 don't, ok.,", "ΑΣ ΑΣ. İ ﬁ", "wor.d ... ,, é́", "<|STARTOFTEXT|> <|startoftext|>x", "À l'œuvre; Straße, ÿ Ÿ µ ª", " ".join(words), "osí. íx í"] * 2
    flat = []
    for first, ends, ids in enc.batches(pa.array([*texts, None], pa.string())):
        assert first == len(flat)
        flat += [x.tobytes() for x in np.split(ids, ends[:-1])]
    assert flat.pop() == b"" and flat == [enc.ids(t) for t in texts]
    for t in texts:
        assert enc.ids(t) == b"".join(i.to_bytes(4, "little") for i in whole(t)), t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_public_tokenizer_as_the_library(name, words, monkeypatch):
    monkeypatch.setattr(common, "WHOLE_SLICE", 200)
    path = common.tokenizer_path(name)
    library, enc = Tokenizer.from_file(path), common.read_encoder(path)
    assert isinstance(enc, common.WordEncoder) == (name == common.TOKENIZER)
    texts = [t for t in ODD if t] + ["  two  blanks and\n\nlines\t", "It's DON'T <|endoftext|> x", " ".join(words), None, "", "é́ ﬁ Ａ　b\u00a0c\u2028d"]
    flat = []
    for first, ends, ids in enc.batches(pa.array(texts, pa.string())):
        assert first == len(flat)
        flat += [x.tolist() for x in np.split(ids, ends[:-1])]
    assert flat == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(enc.ids(t), "<u4").tolist() for t in texts] == flat


def test_rules_that_differ_are_not_taken_for_words(tmp_path):
    rules = json.loads(Tokenizer.from_file(common.tokenizer_path()).to_str())
    rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L} ]+"
    (tmp_path / "other.json").write_text(json.dumps(rules))
    enc, library = common.read_encoder(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert not isinstance(enc, common.WordEncoder)
    assert np.frombuffer(enc.ids("two words"), "<u4").tolist() == library.encode("two words", add_special_tokens=False).ids


@pytest.mark.parametrize("change", [lambda t: t.add_tokens(["hello world"]), lambda t: t.add_tokens(["hello"]), lambda t: t.add_special_tokens(["<|a b|>"]), lambda t: t.enable_truncation(3), lambda t: t.enable_padding(length=9), lambda t: setattr(t, "post_processor", TemplateProcessing(single="$A <|endoftext|>", special_tokens=[("<|endoftext|>", t.token_to_id("<|endoftext|>"))]))])
def test_what_else_works_on_texts_rules_words_out(change, tmp_path):
    made, path = Tokenizer.from_file(common.tokenizer_path()), str(tmp_path / "changed.json")
    change(made)
    made.save(path)
    enc, library = common.read_encoder(path), Tokenizer.from_file(path)
    assert not isinstance(enc, common.WordEncoder)
    for text in ["hello world, hello", "Othello worlds", "a <|a b|> b", "", "one two three four five"]:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_files_hold_every_document(spark, docs, whole, tmp_path):
    df, rows = docs
    path = str(tmp_path / "tokens")
    token_files.write_tokens(df, path, common.tokenizer_path())
    got = [(r["doc_id"], r["n_tokens"], r["ids_crc32"], r["start"]) for r in token_files.ids_crc32(token_files.read_tokens(spark, path)).collect()]
    got.sort(key=lambda r: r[3])
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*whole(t), 1]
        want.append((d, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)), start))
        start += len(ids)
    assert [(r[0], r[3]) for r in got] == [(w[0], w[3]) for w in want]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert token_files.read_index(spark, path).count() == len(rows)


def test_format_and_selective_reads(spark, docs, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs[0], path, common.tokenizer_path())
    file = next((tmp_path / "tokens").glob("*.parquet"))
    columns = {c["path_in_schema"]: c for c in (pq.ParquetFile(file).metadata.row_group(0).column(i).to_dict() for i in range(5))}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"]["encodings"] 
    column = pq.ParquetFile(file).metadata.row_group(0).column(0)
    assert column.has_offset_index and column.has_column_index
    assert any("DICTIONARY" in e for e in next(c for p, c in columns.items() if p.startswith("ids"))["encodings"])
    plan = token_files.read_index(spark, path).where("doc_id = 5")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan" in plan or "EqualTo(doc_id,5)" in plan
    assert "ids:array" not in plan


def test_no_documents(spark, none, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(none, path, common.tokenizer_path())
    assert token_files.ids_crc32(token_files.read_tokens(spark, path)).count() == 0
