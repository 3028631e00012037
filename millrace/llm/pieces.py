"""SentencePiece encoding and decoding with a table of distinct chunks (operator 11).

No piece of the vocabulary goes on into a white-space marker, so a marked text
falls into chunks (markers and what follows them) that are segmented each for
itself. Texts are taken in blocks. A block keeps its distinct chunks and, for
each place of its texts, which of them stands there. The chunks of all blocks
are dealt by a hash into the parts of one table, in which each is segmented
once; the ids go back to the blocks, are joined to the places, and are decoded.
Texts themselves are never shuffled, and a frequent chunk is one row a block.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MODEL = "piece_bpe_32k.model"
#: Characters of the texts of a block, about; a text stays whole.
BLOCK = 32 << 20
#: Fixed value: the marker that white space becomes.
MARK = "▁"
#: A chunk: markers and what follows up to the next, or a line end and what follows (no piece holds one).
_CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")
_BLOCKS = pa.schema([("block", pa.string()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("places", pa.binary()), ("slots", pa.binary()), ("parts", pa.list_(pa.struct([("part", pa.int32()), ("lengths", pa.binary()), ("chunks", pa.binary())])))])
_BLOCKS_DDL = "block string, docs array<bigint>, sizes array<int>, places binary, slots binary, parts array<struct<part: int, lengths: binary, chunks: binary>>"


class Model:
    """A sentencepiece model, and whether its texts may be cut into chunks."""

    def __init__(self, path: str):
        import sentencepiece

        self._lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = self._lib.eos_id()
        self.by_chunks = self._fits()
        self._mark = self._lib.piece_to_id(MARK)

    def _fits(self) -> bool:
        """Whether white space is only marked, one marker goes before, no piece but one of markers goes on into a marker, and none holds a line end."""
        lib = self._lib
        spec = self._spec()
        plain = spec is not None and spec.trainer_spec.model_type == 2 and not spec.normalizer_spec.precompiled_charsmap and spec.normalizer_spec.add_dummy_prefix and not spec.normalizer_spec.remove_extra_whitespaces and spec.normalizer_spec.escape_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
        if not plain or any(p.type == 4 for p in spec.pieces) or lib.is_unknown(lib.piece_to_id(MARK)):  # 4: defined by the user, which are matched before all else
            return False
        own = [p.piece for p in spec.pieces if p.type in (1, 5)]
        return not any(MARK in p.lstrip(MARK) or "\n" in p for p in own)

    def _spec(self):
        try:
            from sentencepiece import sentencepiece_model_pb2 as described
        except ImportError:  # without a reader of the model's own description nothing is known of it
            return None
        out = described.ModelProto()
        out.ParseFromString(self._lib.serialized_model_proto())
        return out

    def chunks(self, text: str) -> list[str]:
        """The chunks of a whole text, or the text where it may not be cut."""
        if not text:
            return []
        return _CHUNK.findall(MARK + text.replace(" ", MARK)) if self.by_chunks else [text]

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """The ids of chunks. The library puts a marker before each; it is the chunk's first one, or goes again before a line end."""
        if not self.by_chunks:
            return self._lib.encode(chunks, num_threads=1)
        found = self._lib.encode([c if c[0] == "\n" else c[1:].replace(MARK, " ") for c in chunks], num_threads=1)
        return [ids[1:] if c[0] == "\n" else ids or [self._mark] for c, ids in zip(chunks, found, strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self._lib.decode(ids)


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    """The worker's model for ``path``, kept from task to task."""
    if path not in _MODELS:
        _MODELS.clear()
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _blocks(docs: DataFrame, path: str, parts: int) -> DataFrame:
    """Texts in blocks: their chunks by part of the table, and for each place the chunk's rank by frequency in the block.

    A task fills a block from as many batches as it takes; what it keeps of
    texts is their distinct chunks and a number for each place.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, done = model(path), 0
        ids, sizes, codes, size = [], [], [], 0
        known: dict[str, int] = defaultdict(itertools.count().__next__)

        def block() -> pa.RecordBatch:  # the table is written once, so the numbers of its task and in it name a block for good
            return _block(f"{TaskContext.get().partitionId()}-{done}", ids, sizes, np.concatenate(codes), [c.encode() for c in known], parts)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = text.as_py() or ""
                found = made.chunks(t)
                ids.append(doc)
                sizes.append(len(found))
                codes.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                size += len(t)
                if size >= BLOCK:
                    yield block()
                    done += 1
                    ids, sizes, codes, size = [], [], [], 0
                    known = defaultdict(itertools.count().__next__)
        if ids:
            yield block()

    return docs.mapInArrow(common.tidied(work), _BLOCKS_DDL)


def _block(key: str, ids: list, sizes: list[int], codes: np.ndarray, names: list[bytes], parts: int) -> pa.RecordBatch:
    part = [zlib.crc32(n) % parts for n in names]
    by_part = np.array(sorted(range(len(names)), key=lambda k: (part[k], names[k])), np.int64)  # slots: the chunks in order of their part
    by_count = np.argsort(-np.bincount(codes, minlength=len(names)), kind="stable")
    slot, rank = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
    slot[by_part], rank[by_count] = np.arange(len(names)), np.arange(len(names))
    rows = []
    for p, mine in itertools.groupby(by_part.tolist(), part.__getitem__):
        some = [names[k] for k in mine]
        rows.append({"part": p, "lengths": common.packed_numbers(np.array([len(n) for n in some])), "chunks": zstandard.compress(b"".join(some), 3)})
    return common.batch(_BLOCKS, [key], pa.array([ids], _BLOCKS.field("docs").type), [sizes], [common.packed_numbers(rank[codes])], [common.packed_numbers(slot[by_count])], [rows])


def _segmented(parts: DataFrame, path: str) -> DataFrame:
    """Of each part of the table and each block the ids of its chunks; every chunk of a part is segmented once.

    A part comes as one group: it holds the chunks that fall to it, a few bytes
    for each block that has them, and there are as many parts as the session
    has shuffle partitions.
    """

    def work(t: pa.Table) -> pa.Table:
        made, rows = model(path), t.to_pylist()
        known: dict[bytes, int] = {}
        at = []
        for r in rows:
            ends = np.cumsum(common.unpacked_numbers(r["lengths"]), dtype=np.int64).tolist()
            text = zstandard.decompress(r["chunks"])
            at.append([known.setdefault(text[i:j], len(known)) for i, j in zip([0, *ends[:-1]], ends, strict=True)])
        found = [np.array(x, "<u4") for x in made.segment([c.decode() for c in known])]
        out = {"block": [], "part": [], "counts": [], "ids": []}
        for r, mine in zip(rows, at, strict=True):
            out["block"].append(r["block"])
            out["part"].append(r["part"])
            out["counts"].append(common.packed_numbers(np.array([len(found[i]) for i in mine])))
            out["ids"].append(common.packed_numbers(np.concatenate([found[i] for i in mine])))
        common.release()
        return pa.table(out, pa.schema([("block", pa.string()), ("part", pa.int32()), ("counts", pa.binary()), ("ids", pa.binary())]))

    return parts.groupBy("part").applyInArrow(work, "block string, part int, counts binary, ids binary")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, the end id last) and decoded text of each row of ``docs`` (doc_id, text).

    Ids are those that the sentencepiece library gives for the whole text, with
    the end id behind, and the text is what its decode makes of them. Null
    texts are empty, and have the end id alone. Rows with equal or null doc_id
    stay rows of their own; other columns play no part; an empty table gives no
    rows. A text and its ids must fit into a worker's memory. Models whose
    pieces may cross markers, that normalise, or that are no BPE are used
    alike, with whole texts for chunks.
    """
    return _joined(docs, path, _texts, "doc_id long, ids binary, text string")


def _texts(ids: np.ndarray, words: list[str], decoded: str) -> tuple:
    return ids.astype("<u4").tobytes(), decoded


def _digests(ids: np.ndarray, words: list[str], decoded: str) -> tuple:
    return len(ids), hashlib.sha256(" ".join(words).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by blanks) and decoded_sha256 of each row, as ``encode`` has them."""
    return _joined(docs, path, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _joined(docs: DataFrame, path: str, tell, ddl: str) -> DataFrame:
    spark = docs.sparkSession
    n = common.shuffle_partitions(spark)
    with common.Scratch(spark) as tmp:
        # dealt by block into as many files as a shuffle has partitions: the answers go to the blocks, which stay where they are
        name = f"millrace_pieces_{uuid.uuid4().hex}"
        made = _blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, n)
        made.write.format("parquet").bucketBy(n, "block").option("path", tmp.path("blocks")).saveAsTable(name)
        blocks = spark.table(name)
        asked = blocks.select("block", F.explode("parts").alias("p")).select("block", "p.*")
        answers = _segmented(asked, path)

        def work(mine: pa.Table, found: pa.Table) -> pa.Table:
            made, columns = model(path), []
            order = np.argsort(found["part"].to_numpy(), kind="stable").tolist()
            counts = np.concatenate([np.zeros(0, "<u4"), *[common.unpacked_numbers(found["counts"][i].as_py()) for i in order]]).astype(np.int64)
            flat = np.concatenate([np.zeros(0, "<u4"), *[common.unpacked_numbers(found["ids"][i].as_py()) for i in order]])
            starts = np.cumsum(counts) - counts
            for row in mine.select(["docs", "sizes", "places", "slots"]).to_pylist():
                slot = common.unpacked_numbers(row["slots"]).astype(np.int64)
                size, start = counts[slot], starts[slot]  # by rank
                words = [" ".join(map(str, flat[i : i + k].tolist())) for i, k in zip(start.tolist(), size.tolist(), strict=True)]
                places, begin = common.unpacked_numbers(row["places"]), 0
                for doc, k in zip(row["docs"], row["sizes"], strict=True):
                    at = places[begin : begin + k]
                    begin += k
                    each = size[at]
                    ends = np.cumsum(each)
                    ids = flat[np.repeat(start[at] - (ends - each), each) + np.arange(ends[-1] if k else 0)]
                    ids = np.append(ids, np.uint32(made.end))
                    columns.append((doc, *tell(ids, [*[words[i] for i in at.tolist()], str(made.end)], made.decode(ids.tolist()))))
            common.release()
            names = [f.split()[0] for f in ddl.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])
            return pa.table([pa.array([c[i] for c in columns], schema.field(i).type) for i in range(len(names))], schema=schema)

        places = blocks.select("block", "docs", "sizes", "places", "slots")
        try:
            return common.written(places.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, ddl), "pieces")
        finally:
            spark.sql(f"DROP TABLE {name}")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return digests(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.tokenizer_path(MODEL))


QUERIES = {"op11_sentencepiece": op11_sentencepiece}
#: The segmentation is beyond SQL; tests hold it against the library.
ORACLE_SQL: dict[str, str] = {}
