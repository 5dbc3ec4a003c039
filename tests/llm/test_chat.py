"""Folding, rendering and reading back conversations."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from changeloom.llm import chat

texts = st.text(alphabet="ab⟪⟫⁅012/\n ", max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), texts), texts), max_size=6))
def test_render_is_reversible(messages):
    text, spans = chat.render(messages)
    assert chat.parse(text) == messages
    said = "".join(chat.unescape(text[a:z]) for a, z in zip(spans[::2], spans[1::2]))
    assert said == "".join(t for r, t in messages if r == "assistant")


def test_fold():
    log = [("message", "user", "q", None), ("delta", "assistant", "he", None), ("delta", "assistant", "llo", None), ("message", "user", "more", None), ("delta", "assistant", "x", None), ("regenerate", "assistant", "y", None), ("delta", "assistant", "z", None), ("edit", None, "Q", 0), ("edit", None, "no", 77), (None, None, None, None)]
    assert chat.fold(log) == [("user", "Q"), ("assistant", "hello"), ("user", "more"), ("assistant", "yz"), ("", "")]
    assert chat.fold([("regenerate", None, "t", 0)]) == [("assistant", "t")] and chat.fold([]) == []


def test_logs(spark):
    rows = [(1, 2, "assistant", None), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, 1, "user", "⟪/⟫"), (2, 5, None, "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in chat.read_back(chat.format_log(chat.events_of(table))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\na\nuser\na\nassistant\n\n") and got[1].loss_chars == 0
    assert got[None].turns_sha256 == sha("user\n⟪/⟫\n") and got[2].turns_sha256 == sha("\n\n")
    assert chat.format_log(chat.events_of(table.where("false"))).count() == 0
