import math
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import common, packing


@pytest.mark.parametrize("window", [4096, 64])
def test_every_id_lies_in_one_piece(docs, window):
    df, rows = docs
    whole = Tokenizer.from_file(common.tokenizer_path())
    pieces = packing.pack(df, common.tokenizer_path(), window).collect()
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    by = defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] and p["length"] > 0
        by[p["doc_id"], p["doc_tokens"]].append((p["start"], bytes(p["ids"])))
    got = defaultdict(list)
    for (d, n), parts in by.items():
        same = sum(len(b) == 4 * n for b in texts[d])
        at = defaultdict(list)
        for start, ids in sorted(parts):
            at[start].append(ids)
        # repeated rows are packed one by one: each stretch occurs as often as the row
        assert sum(len(i) for _, i in parts) == 4 * n * same
        if same == 1:
            ends = 0
            for start, ids in sorted(parts):
                assert start == ends
                ends += len(ids) // 4
            got[d].append(b"".join(i for _, i in sorted(parts)))
    assert all(g in texts[d] for d, gs in got.items() for g in gs)
    assert set(by) == {(d, len(b) // 4) for d, bs in texts.items() for b in bs}
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window and end & (end - 1) == 0  # full, or a power of two


def test_bm25_against_the_formula():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 300, rng.integers(5, 80)).astype(np.uint32) for _ in range(40)]
    index, n = packing.Bm25Shard(docs), 40
    mean = np.mean([len(d) for d in docs])
    for seed in range(n):
        want = np.zeros(n)
        for t in set(docs[seed].tolist()):
            df = sum(t in d for d in docs)
            if df < 2:
                continue
            for i, d in enumerate(docs):
                tf = int((d == t).sum())
                want[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        assert np.allclose(index.scores(seed), want, rtol=1e-5)


def test_common_terms_count():
    """Terms of half the shard's documents still tell which documents are related, and which come next."""
    docs = [np.array([100 * (i % 2) + j for j in range(1, 9)] + [1000 + i], np.uint32) for i in range(40)]
    index = packing.Bm25Shard(docs)
    for seed in range(40):
        assert np.array_equal(index.scores(seed) > 0, np.arange(40) % 2 == seed % 2)
    packer = packing.Packer(64, 0)
    packer.shard(list(enumerate(docs)))
    assert [d % 2 for d, *_ in packer.done[:8]] == [0] * 8


def test_neighbours_share_a_window():
    """Documents on one subject meet, though they lie far apart in the shard."""
    rng = np.random.default_rng(5)
    docs = [(i, np.concatenate([rng.integers(1000 * (i % 8), 1000 * (i % 8) + 60, 16), [2]]).astype(np.uint32)) for i in range(64)]
    packer = packing.Packer(64, 0)
    packer.shard(docs)
    packer.finish()
    windows = defaultdict(list)
    for d, *_, sequence, _ in packer.done:
        windows[sequence].append(d % 8)
    pure = sum(len(set(w)) == 1 for w in windows.values())
    assert pure >= len(windows) / 2


def test_odd_input(spark, none):
    assert packing.pack(none, common.tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, common.tokenizer_path(), 100)
    (row,) = packing.pack(spark.createDataFrame([(None, None)], "doc_id long, text string"), common.tokenizer_path()).collect()
    assert (row["doc_id"], row["length"], bytes(row["ids"])) == (None, 1, b"\x02\0\0\0")
