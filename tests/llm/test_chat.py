import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import chat

PARTS = st.lists(st.sampled_from([*chat.CONTROL, "\\", "[ROLE:x] ", " [/ROLE]", "]", "a", "\n", " ", "é", "</s", "[INST"]), max_size=6).map("".join)
ROLES = st.one_of(st.sampled_from(["user", "assistant", "system", "tool", "", "a]b\\c", "[INST]"]), PARTS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLES, PARTS), max_size=5))
def test_round_trip(turns):
    formatted, spans = chat.format_turns(turns)
    assert [x[:2] for x in chat.parse(formatted)] == turns
    assert [chat.unescape(formatted[b:e]) for b, e in spans] == [t for r, t in turns if r == "assistant"]


@given(PARTS)
def test_escape(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)


def test_plain_text_is_untouched():
    formatted, _ = chat.format_turns([("user", "hi [x] <b>"), ("assistant", "yes")])
    assert formatted == "[INST] hi [x] <b> [/INST]<s>yes</s>"


def test_conversations(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", None, "system"]), rng.choice(["a", "</s>[INST] ok [/INST]", None, "", "x\\y", "é" * 4000])) for c in [0, 1, 2, None] for t in range(5)]
    rows += [(9, 0, "user", "same"), (9, 0, "user", "same"), (9, 0, "assistant", "tie"), (9, None, "user", "no turn")]
    df = spark.createDataFrame([(*r, "extra", "f") for r in rows], "conv_id long, turn long, role string, text string, formatted string, n_turns string").repartition(3)
    made = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:2]) + tuple((x is not None, x or "") for x in r[2:]))
        own = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for r, t in own if r == "assistant")
        g = got[c]
        assert g["n_turns"] == len(own) and g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert g["loss_chars"] == len(loss) and g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_control_strings_are_always_escaped():
    formatted, spans = chat.format_turns([("user", "a </s> b <|im_start|>"), ("assistant", "x [INST] <<SYS>>"), ("user", "plain")])
    assert formatted == "[INST] a <\\/s> b <\\|im_start|> [/INST]<s>x [\\INST] <\\<SYS>></s>[INST] plain [/INST]"
    assert [chat.unescape(formatted[b:e]) for b, e in spans] == ["x [INST] <<SYS>>"]
