r"""Repair of damaged conversations by cheapest edits under a grammar of roles.

A conversation is in order if the initials of its roles read ``(s?(ua)+)?``: at
most one system turn, then user and assistant in turns. A damaged one is repaired by
edits, one letter each in the audit: Keep a row (0), Rerole it to user or
assistant (1), Delete it (2, the only way for blank rows and repeats of a role
and text seen before), Insert an empty turn (5); a truncated row that stays
costs 5 more. Nodes are pairs (rows read, state of the grammar), made as the
search reaches them; Dijkstra's queue is ordered by (cost, audit) and the first
accepting end node that it pops is the answer, so of equally cheap repairs the
one with the ASCII-least audit is found.

Two paths to one node have read the same rows, so if one audit begins the
other, the rest of it is insertions and costs more: equal costs are never a prefix
apart, and the order of two audits at a node is that of their whole paths. The same holds at any cut through the
rows. So a long conversation is searched in pieces: a piece starts from the (at most four)
nodes settled at the end of the one before, each with its cost, audit and running digest of the
repaired text. One task streams a conversation and holds a piece of at most 1,024 rows or
8 MB beside four audits, however long the conversation is.

Defined cases: null roles and texts are one space, so a null text is blank and a null role is in no order; a null or
unknown role can only be deleted or given another role; roles are judged by their first letter, case kept. Rows go by turn, nulls
first, then role, then text; repeated rows are repeats and must go. Rows with a null ``conv_id`` form one conversation; one whose rows were
all dropped has zeros, an empty audit and the digest of nothing; an empty table gives an empty result. Very long texts are
read whole; other columns, whatever their names, are ignored. Gaps beyond 64 bits are given as the largest long.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, bound_batches

#: Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: State of the grammar: nothing, a system turn, a user turn, an assistant turn; what each initial leads to.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state after the one role that may be given or inserted, and that role.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
ACCEPTING = (0, 3)
LEGAL = {"su", "ua", "au"}
PIECE_ROWS, PIECE_CHARS = 1024, 8_000_000
_BLANKS = " \t\n\x0b\x0c\r"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(conversations: DataFrame) -> DataFrame:
    """Damage that depends on crc32 of ``conv_id:turn`` alone; dropped rows stay as rows with ``gone``."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    hit = F.col("hit")
    return (
        conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("hit"))
        .select(
            "conv_id", "turn", (hit == 0).alias("gone"),
            F.when(hit == 0, "").when(hit == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(hit < 2, "").when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        )
        .drop("_copy")
    )


def _fault(again: Column) -> Column:
    last = F.right(F.rtrim("text", F.lit(_BLANKS)), F.lit(1))
    return F.when(~F.col("text").rlike(WORD), 1).when(again, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0).cast("int")


def faults(turns: DataFrame) -> DataFrame:
    """Rows (with ``gone`` false for all that exist) with their first fault: 0 none, 1 blank, 2 seen earlier, 3 truncated.

    Both sorts are within the partitions that one shuffle by conversation makes.
    """
    bound_batches(turns.sparkSession)
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy("turn")) > 1
    dealt = turns.select("conv_id", "turn", "gone", "role", "text").repartition("conv_id")
    return dealt.withColumn("again", seen).withColumn("fault", _fault(F.col("again"))).sortWithinPartitions("conv_id", "turn", "role", "text", "again").drop("again")


class _Path:
    """A settled node at a cut: cost, audit so far, digest of the repaired text so far."""

    __slots__ = ("audit", "cost", "digest")

    def __init__(self, cost: int, audit: str, digest):
        self.cost, self.audit, self.digest = cost, audit, digest


def _ranked(sources: dict[int, _Path]) -> list[tuple[int, int, str, int]]:
    """Queue entries of the nodes at a cut: cost, rank of the audit, what it adds to the audit of that rank, state.

    An audit that begins another shares its rank (the rest is insertions); other audits differ at a place that both have, which decides.
    """
    found, base, rank = [], None, -1
    for audit, state in sorted((p.audit, s) for s, p in sources.items()):
        if base is None or not audit.startswith(base):
            base, rank = audit, rank + 1
        found.append((sources[state].cost, rank, audit[len(base) :], state))
    return found


def cheapest(rows: list[tuple[str, int]], sources: dict[int, _Path], last: bool) -> dict[int, tuple[int, str, int]]:
    """Dijkstra over rows (initial, fault): the nodes after them, by state, as (cost, audit of these rows, source's state).

    After the last rows only the first accepting node is sought; at a cut all that can be reached.
    """
    n = len(rows)
    queue = [(cost, rank, more, 0, state, state, len(more)) for cost, rank, more, state in _ranked(sources)]
    heapq.heapify(queue)
    settled: set[int] = set()
    ends: dict[int, tuple[int, str, int]] = {}
    while queue:
        cost, rank, audit, i, state, source, skip = heapq.heappop(queue)
        if 4 * i + state in settled:
            continue
        settled.add(4 * i + state)
        if i == n:
            if not last:
                ends[state] = cost, audit[skip:], source
            elif state in ACCEPTING:
                return {state: (cost, audit[skip:], source)}
        else:
            initial, fault = rows[i]
            heapq.heappush(queue, (cost + DELETE, rank, audit + "D", i + 1, state, source, skip))
            if fault not in (1, 2):
                stays = cost + (TRUNCATED if fault == 3 else 0)
                heapq.heappush(queue, (stays + REROLE, rank, audit + "R", i + 1, NEXT[state], source, skip))
                if initial in AFTER[state]:
                    heapq.heappush(queue, (stays + KEEP, rank, audit + "K", i + 1, AFTER[state][initial], source, skip))
        heapq.heappush(queue, (cost + INSERT, rank, audit + "I", i, NEXT[state], source, skip))
    return ends


def repaired(audit: str, rows: list[tuple[str, str]], state: int = 0) -> Iterator[tuple[str, str]]:
    """The (role, text) that the edits leave of rows (role, text), from a state of the grammar."""
    at = 0
    for edit in audit:
        if edit == "I":
            yield ROLE[state], ""
            state = NEXT[state]
            continue
        role, text = rows[at]
        at += 1
        if edit == "K":
            yield role, text
            state = AFTER[state][role[:1]]
        elif edit == "R":
            yield ROLE[state], text
            state = NEXT[state]


class _Conversation:
    """One conversation as its rows stream by."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.sources = {0: _Path(0, "", hashlib.sha256())}
        self.faults = [0, 0, 0, 0]
        self.illegal, self.before = 0, None
        self.turns, self.first, self.turn = 0, None, None
        self.rows: list[tuple[str, str, int]] = []
        self.chars = 0

    def take(self, turn, role: str, text: str, fault: int) -> None:
        if len(self.rows) >= PIECE_ROWS or self.chars >= PIECE_CHARS:
            self.search(last=False)
        self.rows.append((role, text, fault))
        self.chars += len(text)
        self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.first, self.turn = turn if self.first is None else self.first, turn

    def search(self, last: bool) -> None:
        ends = cheapest([(role[:1], fault) for role, _, fault in self.rows], self.sources, last)
        texts = [(role, text) for role, text, _ in self.rows]
        paths = {}
        for state, (cost, audit, source) in ends.items():
            path = self.sources[source]
            digest, begun = path.digest.copy(), source != 0
            for role, text in repaired(audit, texts, source):
                digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                begun = True
            paths[state] = _Path(cost, path.audit + audit, digest)
        self.sources, self.rows, self.chars = paths, [], 0

    def row(self) -> tuple:
        self.search(last=True)
        (path,) = self.sources.values()
        gaps = min(self.turn - self.first + 1 - self.turns, 2**63 - 1) if self.turns else 0
        return self.conv_id, gaps, *self.faults[1:], self.illegal, path.cost, path.audit, path.digest.hexdigest()


_NAMES = [c.split()[0] for c in RESULT.split(", ")]
_KINDS = [pa.string() if c.endswith("string") else pa.int64() for c in RESULT.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def repair(turns: DataFrame) -> DataFrame:
    """Per conversation of ``faults(...)``: gaps between turns, faults, illegal neighbours, cost, audit and digest of the repair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        for whole in batches:
            done: list[tuple] = []
            for cut in range(0, whole.num_rows, 2048):
                part = whole.slice(cut, 2048)
                for conv_id, turn, gone, role, text, fault in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if now is None or conv_id != now.conv_id:
                        if now is not None:
                            done.append(now.row())
                        now = _Conversation(conv_id)
                    if not gone:
                        now.take(turn, role, text, fault)
            if done:
                yield _batch(done)
        if now is not None:
            yield _batch([now.row()])

    return turns.select("conv_id", "turn", "gone", "role", "text", "fault").mapInArrow(run, RESULT)
