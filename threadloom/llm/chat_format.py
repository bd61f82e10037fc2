r"""Chat formatting by a finite-state machine over roles.

A template names the mark that opens each role's turn, the mark that closes a
turn, the roles whose text bears loss, and the role transitions that are in
order. Each conversation's turns stream through the machine in turn order and
come out as text segments with a loss flag; nothing holds a whole conversation.

Control strings inside texts are made inert and can be restored: a backslash
becomes two, and each control string gets a backslash after its first
character. Reading back drops each escaping backslash and keeps the character
after it. Since a mark then occurs only where the template put it, the turns can
be read back from the formatted text.

Defined cases: a null text is empty; a null role is the empty role, which every
template treats as out of order; turns out of order are
formatted all the same and counted in ``violations``; turns that share a number
go by role, then text; repeated rows are repeated turns; an empty table gives an
empty result; rows with a null ``conv_id`` form one conversation. Null turns
come first; very long texts are one segment each, whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """Declares marks, loss and turn order; ``{role}`` in ``open_mark`` is the role's title."""

    titles: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    open_mark: str = "### {role}: "
    other: str = "Other"
    close_mark: str = "</turn>"
    after: str = "\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    order: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            START: frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )

    def __post_init__(self):
        if any("\\" in c or not c.strip() for c in self.controls()):
            raise ValueError("a control string is blank or holds a backslash")

    def opening(self, role: str) -> str:
        return self.open_mark.format(role=self.titles.get(role, self.other))

    def controls(self) -> list[str]:
        return sorted({self.open_mark.format(role=t).strip() for t in (*self.titles.values(), self.other)} | {self.close_mark}, key=lambda c: (-len(c), c))

    def escape(self, text: str) -> str:
        inert = text.replace("\\", "\\\\")
        return re.sub(f"(?={'|'.join(map(re.escape, self.controls()))})(.)", r"\1\\", inert, flags=re.S)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)


SEGMENTS = "conv_id long, turn_no long, part int, role string, text string, loss boolean, in_order boolean"


def _ordered(turns: DataFrame, *order: str) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_turns(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of every turn: its opening mark (part 0), its escaped text (1), its closing mark (2)."""
    t = template or Template()
    rows = _ordered(conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = batches  # no conversation has this id
        state, number = START, 0
        for whole in batches:
            for cut in range(0, whole.num_rows, 2048):
                out: list[tuple] = []
                for row in whole.slice(cut, 2048).to_pylist():
                    if row["conv_id"] != at:
                        at, state, number = row["conv_id"], START, 0
                    role = row["role"]
                    fits = role in t.order.get(state, ())
                    state = role if role in t.order else state
                    head = (at, number)
                    out.append((*head, 0, role, t.opening(role), False, fits))
                    out.append((*head, 1, role, t.escape(row["text"]), role in t.loss_roles, fits))
                    out.append((*head, 2, role, t.close_mark + t.after, False, fits))
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _ARROW, strict=True)], names=_NAMES)

    return rows.mapInArrow(run, SEGMENTS)


_NAMES = ["conv_id", "turn_no", "part", "role", "text", "loss", "in_order"]
_ARROW = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, violations long"


class _Reader:
    """Reads one conversation's segments back, as running digests."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss, self.bad = conv_id, 0, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def take(self, part: int, role: str, text: str, loss: bool, in_order: bool) -> None:
        self.chars += len(text)
        plain = Template.unescape(text)
        if part == 1:
            self.turns += 1
            self.bad += not in_order
            self.all.update(f"{role}\n{plain}\n".encode())
        if loss:
            self.loss += len(plain)
            self.masked.update(plain.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars, self.bad


def digest_segments(segments: DataFrame, in_order: bool = False) -> DataFrame:
    """Turn and loss digests of each conversation, read back from its segments.

    A digest over a conversation is sequential, so one task streams each
    conversation; it holds one batch and two hash states, however long that is.
    Segments straight from ``format_turns`` lie together ``in_order`` and are not shuffled again; those
    read from files are.
    """
    rows = segments.select(*_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        now = None
        done: list[tuple] = []
        for b in batches:
            for conv_id, _, part, role, text, loss, fits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(conv_id)
                now.take(part, role, text, loss, fits)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds, strict=True)], names=names)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(now.row(), kinds, strict=True)], names=names)

    return (rows if in_order else _ordered(rows, "turn_no", "part")).mapInArrow(run, DIGESTS)
