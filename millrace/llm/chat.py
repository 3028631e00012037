r"""Chat formatting (operator 9) that proves itself by a grammar round trip.

The grammar of a formatted conversation, with the text of each turn between its
marks::

    conversation = turn*
    turn         = "[SYS] " text " [/SYS]"          role system
                 | "[INST] " text " [/INST]"        role user
                 | "<s>" text "</s>"                role assistant
                 | "[ROLE:" name "] " text " [/ROLE]"   any other role
    text         = (plain | "\" any)*               no bare control string inside

A turn whose text holds a control string or a backslash is escaped, any other
is first rendered as it is. The parser reads the result back; turns that differ
from the source are escaped and the conversation is rendered again, until the
recovered turns are identical. Escaping doubles each backslash and
puts one behind the first character of each control string, so that no control
string is left inside a text; the parser drops the first of each pair.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The marks around a turn, by role.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER_CLOSE = " [/ROLE]"
#: The strings that control a model or this grammar; none stays whole inside an escaped text.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE:", "[/ROLE]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>"]

_CONFLICT = re.compile("|".join(map(re.escape, ["\\", *sorted(CONTROL, key=len, reverse=True)])))
_PAIR = re.compile(r"\\(.)", re.S)
_OTHER_OPEN = re.compile(r"\[ROLE:((?:[^\]\\]|\\.)*)\] ", re.S)

Turn = tuple[str, str]


def escape(text: str) -> str:
    return _CONFLICT.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _PAIR.sub(r"\1", text)


def _marks(role: str) -> tuple[str, str]:
    if role in MARKS:
        return MARKS[role]
    name = re.sub(r"([\]\\])", r"\\\1", role)
    return f"[ROLE:{name}] ", OTHER_CLOSE


def render(turns: list[Turn], escaped: set[int] = frozenset()) -> str:
    """The conversation under the grammar, the turns numbered in ``escaped`` with escapes."""
    out = []
    for i, (role, text) in enumerate(turns):
        before, after = _marks(role)
        out += [before, escape(text) if i in escaped else text, after]
    return "".join(out)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """The turns of a formatted conversation: role, text, and where its rendered text begins and ends.

    Reading is deterministic: the next mark tells the role, and the turn ends at
    the first closing mark. Text that fits no turn raises ValueError.
    """
    at, out = 0, []
    while at < len(formatted):
        for role, (before, after) in MARKS.items():
            if formatted.startswith(before, at):
                begin = at + len(before)
                break
        else:
            if not (m := _OTHER_OPEN.match(formatted, at)):
                raise ValueError(f"no turn begins at {at}")
            role, after, begin = unescape(m[1]), OTHER_CLOSE, m.end()
        end = formatted.find(after, begin)
        if end < 0:
            raise ValueError(f"the turn at {at} does not end")
        out.append((role, unescape(formatted[begin:end]), begin, end))
        at = end + len(after)
    return out


def format_turns(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts, proved by reading it back."""
    escaped = {i for i, (_, text) in enumerate(turns) if _CONFLICT.search(text)}
    while True:
        formatted = render(turns, escaped)
        try:
            read = parse(formatted)
        except ValueError:
            read = []
        if [x[:2] for x in read] == turns:
            return formatted, [(b, e) for role, _, b, e in read if role == "assistant"]
        new = {i for i, t in enumerate(turns) if i not in escaped and (i >= len(read) or read[i][:2] != t or _CONFLICT.search(t[1]))}
        if not new:
            raise AssertionError("escaped turns must read back")
        escaped |= new


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted text and loss spans of every conversation.

    ``turns`` holds conv_id, turn, role and text. Turns are taken in order of
    turn, then role, then text; repeated rows stay; a null turn comes first. A
    null text or role is an empty one, a null conv_id one conversation. Extra
    columns are left out; an empty table gives no rows. ``loss_spans`` are code
    points of ``formatted``. One conversation becomes one row, so it must fit
    into a worker's memory; nothing else is held.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Turn] = []
        key: object = held  # no conversation has this key
        done: list[tuple] = []

        def close() -> None:
            if held:
                formatted, spans = format_turns(held)
                done.append((key, len(held), formatted, [{"start": b, "end": e} for b, e in spans]))
                held.clear()

        for b in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if conv_id != key or key is held:
                    close()
                    key = conv_id
                held.append((role or "", text or ""))
            if done:
                yield common.batch(schema, *zip(*done, strict=True))
                done.clear()
        close()
        if done:
            yield common.batch(schema, *zip(*done, strict=True))

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = common.spread(rows, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(fold, "conv_id long, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the parser reads back from formatted conversations, as counts and digests."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv_id, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                both = "".join(f"{role}\n{said}\n" for role, said, _, _ in turns)
                out.append((conv_id, len(turns), hashlib.sha256(both.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                yield common.batch(schema, *zip(*out, strict=True))

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more of control strings, formatted and read back."""
    probe = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -1L AS conv_id, t AS turn, r AS role, '{probe}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    return digests(format_conversations(common.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(more)))


QUERIES = {"op9_chat_format": op9_chat_format}
_SQL_CONFLICT = r"\\|<\|startoftext\|>|<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|<</SYS>>|<<SYS>>|\[/INST\]|\[/ROLE\]|\[/SYS\]|\[INST\]|\[ROLE:|\[SYS\]|</s>|<s>"
ORACLE_SQL = {
    "op9_chat_format": rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS said FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(said) + len(regexp_extract_all(said, '{_SQL_CONFLICT}'))
    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
       ELSE 16 + length(role) + len(regexp_extract_all(role, '[\]\\]')) END AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY turn, role, said)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(said) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN said END, '' ORDER BY turn, role, said), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""
}
