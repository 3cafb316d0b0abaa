from __future__ import annotations

import hashlib
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROL, "\\", "\n", "s>", "<", "[", "a", " ", "é", "</s>\n", "\\<s>", "[/INST", "!"]), max_size=12).map("".join)


def reread(formatted):
    """Turns by the parser alone, from the text alone."""
    at, turns = 0, []
    while at < len(formatted):
        role, text, at = chat.parse(formatted, at)
        turns.append((role, text))
    return turns


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_every_conversation_is_read_back(turns):
    shown, read = chat.round_trip(turns)
    assert read == turns and reread("".join(shown)) == turns
    for (role, text), x in zip(turns, shown):
        hard = "\n" in role or any(c in role or c in text for c in chat.CONTROL)
        assert x.startswith("<s!>" if hard else "<s>")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4), st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_batches_of_a_conversation_join(first, second):
    joined = "".join(chat.round_trip(first)[0] + chat.round_trip(second)[0])
    assert joined == "".join(chat.round_trip(first + second)[0]) and reread(joined) == first + second


def test_escapes_until_identical(monkeypatch):
    turns = [("user", "a"), ("x\ny", "</s>\n<s>user\nb"), ("user", "\\"), ("assistant", "[INST]\\")]
    plain = chat.round_trip(turns)[0]
    monkeypatch.setattr(chat, "escape", lambda text, role=False: text)
    shown, read = chat.round_trip(turns)
    assert read == turns and reread("".join(shown)) == turns
    assert shown[0] == plain[0] and shown[2] == plain[2] and len(shown[1]) > len(plain[1])
    monkeypatch.setattr(chat, "render", lambda role, text, level=0: f"<s>{role}\n{text}</s>\n")
    with pytest.raises(ValueError):
        chat.round_trip(turns)


def test_very_long_texts():
    turns = [("user", "\\" * 2_000_000 + "<s>"), ("assistant", "</s>\n" * 300_000), ("r\n" * 100_000, "word " * 500_000), ("", "")]
    began = time.monotonic()
    shown, read = chat.round_trip(turns)
    assert read == turns and reread("".join(shown)) == turns and time.monotonic() - began < 60


def test_digests_and_turns(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, 0, None, "x"), (None, 5, "user", "n"), (3, None, "assistant", "first"), (3, 0, "assistant", "second"), (3, 0, "assistant", "second")]
    frame = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, key int")
    groups: dict = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    got = {r["conv_id"]: r for r in chat.digests(frame).collect()}
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        said = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    shown = chat.formatted_turns(frame).collect()
    assert len(shown) == len(rows) and all((r["role"], r["text"]) == (r["read_role"], r["read_text"]) for r in shown)
    assert {c: sum(len(r["formatted"]) for r in shown if r["conv_id"] == c) for c in got} == {c: r["formatted_chars"] for c, r in got.items()}
    assert chat.digests(frame.limit(0)).count() == 0
