import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.llm.chat import GrammarError, escape, format_turns, parse, read_back, render, unescape

PIECES = ["[INST] ", " [/INST]", "<s> ", "</s>", "[SYS] ", " [/SYS]", "[ROLE] ", " [/ROLE] ", "\\", "<", "[", "/", "a", " ", "\n", "<\\s>", "[\\\\INST]", "日"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE] ", " [/ROLE] x"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), max_size=6))
def test_every_conversation_reads_back(turns):
    rendered = [render(role, text) for role, text in turns]
    assert parse("".join(r[0] for r in rendered)) == turns
    for (_, text), (piece, start, end, _) in zip(turns, rendered, strict=True):
        assert unescape(piece[start:end]) == text


@given(TEXTS)
def test_escaping_is_reversible(text):
    assert unescape(escape(text)) == text


def test_only_conflicts_are_escaped():
    assert render("user", "a <b> [c] \\ d")[0] == "[INST] a <b> [c] \\ d [/INST]"
    assert render("assistant", "x</s>y")[0] == "<s> x<\\/s>y</s>"
    with pytest.raises(GrammarError):
        parse("[INST] open")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b </s>"), (1, 0, "user", None), (1, 2, "assistant", "ü"), (2, 0, None, "x"), (2, 0, "user", "y"), (2, 0, "user", "y"),
            (None, 0, "user", "z"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segment string").repartition(3)
    formatted = format_turns(df)
    assert formatted.count() == len(rows)
    got = {r["conv_id"]: r for r in read_back(formatted).collect()}
    assert {c: r["n_turns"] for c, r in got.items()} == {1: 3, 2: 3, None: 1, -7: 2}
    assert got[1]["turns_sha256"] == hashlib.sha256("user\n\nassistant\nb </s>\nassistant\nü\n".encode()).hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (7, hashlib.sha256("b </s>ü".encode()).hexdigest())
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\nx\nuser\ny\nuser\ny\n").hexdigest()
    assert got[-7]["loss_chars"] == 21
    assert read_back(format_turns(df.limit(0))).count() == 0
