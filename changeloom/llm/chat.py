"""Operator 8: chat formatting by event-sourced reconstruction.

A log of events (conversation, sequence, kind, role, text, target) is dealt by conversation and sorted by sequence; a fold
turns it into final messages, which a template renders together with a loss mask over assistant texts.

Kinds of events:
  message     a new message
  delta       text appended to the last message when it is open and of the same role, else a new open message
  edit        replaces the text of message `target` (its place, from 0); without such a message it does nothing
  regenerate  drops message `target` and all after it (null target: the last assistant message); its text starts anew
Null kinds count as messages, null texts as empty, null roles as the empty role. Events of equal sequence are taken in order of
kind, role, text. Rows of a null conversation form one conversation. An empty log gives no rows.

The template writes  ⟪role⟫text⟪/⟫  a turn; inside roles and texts the signs ⟪, ⟫ and ⁅ become ⁅1, ⁅2 and ⁅0, so no text can
end a turn or pass for one, and `parse` gives back what was written.

The fold streams over sorted rows: a task holds one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.common import in_worker

OPEN, CLOSE, MARK = "⟪", "⟫", "⁅"
END = f"{OPEN}/{CLOSE}"
_ESCAPED = {MARK: MARK + "0", OPEN: MARK + "1", CLOSE: MARK + "2"}
_PLAIN = {v: k for k, v in _ESCAPED.items()}
_SIGNS, _MARKS = re.compile(f"[{OPEN}{CLOSE}{MARK}]"), re.compile(f"{MARK}[012]")
_TURN = re.compile(f"{OPEN}([^{OPEN}{CLOSE}]*){CLOSE}([^{OPEN}{CLOSE}]*){re.escape(END)}")


def escape(text: str) -> str:
    return _SIGNS.sub(lambda m: _ESCAPED[m[0]], text)


def unescape(text: str) -> str:
    return _MARKS.sub(lambda m: _PLAIN[m[0]], text)


def fold(events: Iterable[tuple]) -> list[tuple[str, str]]:
    """Final (role, text) messages of the sorted events (kind, role, text, target) of one conversation."""
    roles: list[str] = []
    texts: list[list[str]] = []
    open_at = -1
    for kind, role, text, target in events:
        role, text = role or "", text or ""
        if kind == "delta" and open_at == len(roles) - 1 >= 0 and roles[-1] == role:
            texts[-1].append(text)
        elif kind == "edit":
            if target is not None and 0 <= target < len(roles):
                texts[target] = [text]
        elif kind == "regenerate":
            if target is None:
                target = next((k for k in range(len(roles) - 1, -1, -1) if roles[k] == "assistant"), len(roles))
            target = max(0, target)
            del roles[target:], texts[target:]
            roles.append(role or "assistant"), texts.append([text])
            open_at = len(roles) - 1
        else:
            roles.append(role), texts.append([text])
            open_at = len(roles) - 1 if kind == "delta" else -1
    return [(r, "".join(t)) for r, t in zip(roles, texts, strict=True)]


def render(messages: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[int]]:
    """The formatted conversation and the loss mask as flat [begin, end) offsets in characters."""
    out, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{escape(role)}{CLOSE}", escape(text)
        out += [head, body, END]
        if role == trained and body:
            spans += [at + len(head), at + len(head) + len(body)]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages that `render` wrote."""
    out, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


#: Schema of the log. `conv` may be null.
EVENTS = "conv long, seq long, kind string, role string, text string, target int"
FORMATTED = "conv_id long, formatted string, loss_spans array<int>"


def format_log(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of every conversation of a log with the columns of EVENTS."""
    order = ["conv", "seq", "kind", "role", "text", "target"]
    dealt = events.select(*order).repartition("conv").sortWithinPartitions(*order)

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, log, seen, rows, size = None, [], False, [], 0
        for b in batches:
            for c, *event in zip(b.column(0).to_pylist(), *(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                if seen and c != conv:
                    rows.append((conv, *render(fold(log))))
                    size += len(rows[-1][1])
                    log = []
                    if size > 1 << 22:
                        yield _rows(rows)
                        rows, size = [], 0
                conv, seen = c, True
                log.append(event)
        if seen:
            rows.append((conv, *render(fold(log))))
        if rows:
            yield _rows(rows)

    return dealt.mapInArrow(run, FORMATTED)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    conv, text, spans = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(text, pa.string()), pa.array(spans, pa.list_(pa.int32()))], names=["conv_id", "formatted", "loss_spans"])


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output says, by conversation: turns and their digest, characters and digest under the loss mask."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(text)
                lost = unescape("".join(text[a:z] for a, z in zip(spans[::2], spans[1::2], strict=True)))
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), _digest(said), len(lost), _digest(lost), len(text)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def events_of(conversations: DataFrame) -> DataFrame:
    """A log of the table conversations: one message a row."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text", F.lit(None).cast("int").alias("target")
    )
