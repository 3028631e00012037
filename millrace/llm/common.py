"""What several operators share: tables, the folder all machines see, tokenizers."""

from __future__ import annotations

import array
import ctypes
import functools
import gc
import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tokenizer of the registered queries; its place is a parameter of every operator.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public vocabulary file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of a data folder, reduced to ``columns``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset and all
    runs on one machine, as in tests, a temporary folder is made and kept for the
    session; on a cluster there is no such folder, and that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        path = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for ``name`` in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: its lineage ends here.

    The files outlive lost executors; they go with the shared folder.
    """
    return _stored(df, shared_path(df.sparkSession, name))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator call in the shared folder, which are deleted as soon as they are not needed.

    ``with Scratch(spark) as tmp:`` deletes what is left at its end, so a result
    has to be written elsewhere before.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._folder = spark, shared_path(spark, "scratch")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self._delete(self._folder)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table of this call."""
        return _stored(df, self.path(name))

    def path(self, name: str) -> str:
        """A new path for a table of this call."""
        return f"{self._folder}/{name}-{uuid.uuid4().hex}"

    def drop(self, name: str) -> None:
        """Delete the tables called ``name``, and let Spark delete shuffle files that nothing refers to."""
        for found in self._files().globStatus(self._path(f"{self._folder}/{name}-*")) or []:
            self._files().delete(found.getPath(), True)
        self.free()

    def free(self) -> None:
        """Let Spark delete shuffle files that nothing refers to."""
        gc.collect()
        self._spark._jvm.System.gc()

    def _path(self, path: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._path(self._folder).getFileSystem(self._spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        self._files().delete(self._path(path), True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` over the session's shuffle partitions.

    The count is stated, so that adaptive execution does not join small
    partitions whose rows are costly to work on.
    """
    return df.repartition(shuffle_partitions(df.sparkSession), *[F.col(k) for k in keys])


def tidied(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of a task's batches that gives freed memory back to the system at the task's end.

    Python workers are kept for later tasks, and freed memory would else stay theirs.
    """

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def release() -> None:
    """Give freed memory back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_ENCODERS: dict[str, Encoder] = {}


#: Bytes of texts that are encoded together, about: by words, and as whole texts, whose encodings are larger.
SLICE, WHOLE_SLICE = 4 << 20, 1 << 20
#: The rules under which white space parts words for good and plain Latin letters are only lower-cased.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: A word of Latin letters, maybe with ASCII marks behind: its letters are one unit of the tokenizer, and the marks another.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def _byte_level() -> dict[int, str]:
    """Latin letters in lower case, each UTF-8 byte as its character in byte-level vocabularies.

    Bytes that print stand for themselves; the others follow from U+0100 on.
    """
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = dict(zip(prints, map(chr, prints), strict=True)) | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(prints))}
    return {ord(c): "".join(chars[b] for b in c.lower().encode()) for c in map(chr, [*range(65, 91), *range(0xC0, 0x100)]) if c.isalpha()}


_BYTE_LEVEL = _byte_level()


def _slices(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """The texts some at a time, of about ``size`` bytes, each with the index of its first."""
    turn = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(texts)]
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        if last > first:
            yield first, texts.slice(first, last - first)


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them."""

    def __init__(self, tokenizer):
        self._tokenizer = tokenizer

    def ids(self, text: str | None) -> bytes:
        """The ids of the whole text as little-endian unsigned 32-bit integers."""
        return self._whole(text or "")

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The ids of many texts, some at a time: the first text's index, where each text's ids end, and all ids."""
        for first, part in _slices(pc.fill_null(texts, ""), WHOLE_SLICE):
            found = [e.ids for e in self._tokenizer.encode_batch_fast(part.to_pylist(), add_special_tokens=False)]
            yield first, np.cumsum([len(x) for x in found]), np.fromiter((i for x in found for i in x), "<u4")

    def _whole(self, text: str) -> bytes:
        return array.array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class WordEncoder(Encoder):
    """Token ids of texts for tokenizers with WORD_RULES, with the ids of each blank-separated word kept.

    These rules drop white space and let no token reach across it, so the ids of
    a text are those of its words in a row. A word is encoded by the tokenizers
    library: plain Latin words, which the rules only lower-case, by its model at
    once, all others by the whole tokenizer. Words seen lately are looked up in
    two generations of at most ``limit`` words of at most ``longest`` letters
    (about 200 bytes a word), which bounds the memory and changes no result.
    """

    def __init__(self, tokenizer, limit: int = 100_000, longest: int = 40):
        super().__init__(tokenizer)
        self._model = tokenizer.model
        self._known: dict[str, bytes] = {"": b""}
        self._older: dict[str, bytes] = {}
        self._marks: dict[str, bytes] = {}
        self._limit, self._longest = limit, longest

    def ids(self, text: str | None) -> bytes:
        words = text.replace("\n", " ").split(" ") if text else []
        return b"".join([self._word(w) for w in words])

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        # each different word is looked up once, and its ids are copied to where it occurs
        for first, part in _slices(pc.fill_null(texts, ""), SLICE):
            yield first, *self._slice(part)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else a control string in capitals would become one
            texts = pc.ascii_lower(texts)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        known, word = self._known.get, self._word
        found = [known(w) or word(w) for w in words.dictionary.to_pylist()]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, start = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        at = words.indices.to_numpy()
        each = size[at]
        ends = np.cumsum(each)
        places = np.repeat((start[at] - (ends - each)).astype(np.int32), each) + np.arange(ends[-1], dtype=np.int32)
        offsets = lists.offsets.to_numpy()
        return np.concatenate([[0], ends])[offsets[1:] - offsets[0]], flat[places]

    def _word(self, word: str) -> bytes:
        """The ids of a word, which is then among the known ones."""
        if (ids := self._known.get(word)) is not None:
            return ids
        if (ids := self._older.get(word)) is None:
            if word.isascii() and word.isalpha():
                ids = array.array("I", [t.id for t in self._model.tokenize(word.lower())]).tobytes()
            elif (m := _PLAIN.fullmatch(word)):
                letters, marks = m.groups()
                if marks:
                    ids = self._word(letters) + self._mark(marks)
                else:
                    ids = array.array("I", [t.id for t in self._model.tokenize(word.translate(_BYTE_LEVEL))]).tobytes()
            else:
                ids = self._mark(word)
        if len(word) <= self._longest:
            if len(self._known) >= self._limit:
                self._older, self._known = self._known, {"": b""}
            self._known[word] = ids
        return ids

    def _mark(self, word: str) -> bytes:
        short = len(word) <= 4
        if short and (ids := self._marks.get(word)) is not None:
            return ids
        ids = self._whole(word)
        if short and len(self._marks) < 10_000:
            self._marks[word] = ids
        return ids


def read_encoder(path: str, **limits: int) -> Encoder:
    """An encoder for the tokenizer file ``path``: by words if its rules are WORD_RULES and nothing else works on texts, else of whole texts.

    Nothing else does if it neither cuts, pads nor adds to ids, and its added tokens begin
    with ``<|``, may stand anywhere and hold no white space.
    """
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    rules = json.loads(made.to_str())
    plain = not any(rules[k] for k in ("truncation", "padding", "post_processor")) and rules["model"]["type"] == "BPE" and not rules["model"].get("dropout")
    # added tokens are looked for before all rules: none may be a part of plain words or reach over white space
    apart = all(t["content"].startswith("<|") and not t["single_word"] and not re.search(r"\s", t["content"]) for t in rules["added_tokens"])
    by_words = all(rules.get(k) == v for k, v in WORD_RULES.items()) and plain and apart
    return WordEncoder(made, **limits) if by_words else Encoder(made)


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``; a reused worker keeps it from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = read_encoder(path)
    return _ENCODERS[path]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """An Arrow batch of Python or NumPy columns under ``schema``."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def packed_numbers(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 32, compressed: bytes of one weight lie together, so small numbers take little room."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 3)


def unpacked_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()
