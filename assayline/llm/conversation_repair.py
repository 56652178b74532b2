"""Conversation structure repair as a lightest derivation: Knuth's agenda over edit deductions.

A conversation is well formed when its role initials read ``(s?(ua)+)?`` and no row is blank or
repeated. Its repair is a derivation in a weighted hypergraph. An item ``(i, state)`` says that the
first i rows have been edited into a text whose roles bring the automaton of that pattern to a
state; a deduction combines an item with the next row (keep, rerole, delete) or with none
(insert) into another item and adds to its weight ``(cost, audit)``, where the audit holds the
initials of the edits. Appending never lowers a weight, and among equal costs no audit is a
beginning of another (the letters fix the cost), so every deduction is a monotone superior
function: an item is final when the agenda gives it out, and the repair is known when
the goal item comes out.

Faults are found by column functions: blank, then duplicate (a window over equal rows), then
truncated. Rows then stream through a task sorted by conversation and turn, in segments of at
most ``SEGMENT`` rows. A segment starts from the lightest items at its beginning; what all
of them agree on is decided, written out and forgotten, so a conversation of any length takes
little memory. Only its digest and its audit are sequential.

Nulls in ``role`` and ``text`` count as one space; a null turn sorts first, a null ``conv_id`` is a
conversation of its own. Rows of one turn are taken by role, then text. An empty table gives
no rows; a conversation without rows gives zeros, an empty audit and the digest of nothing.
Columns other than ``conv_id, turn, role, text`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

# the automaton of (s?(ua)+)?: states 0 (start), 1 after s, 2 after u, 3 after a
START, ACCEPTING = 0, (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

_SPACES = r"\x20\x09-\x0D"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped``: rows damaged by a checksum of their place.

    Of every 20 checksums 0 drops the row (it stays as a mark of its conversation), 1 empties its
    text, 2 removes full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    blank = F.lit(" ")
    place = F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank)
    )
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.crc32(place.cast("binary")) % 20).alias("harm"),
    )
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("harm") == 0).alias("dropped"),
        F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped, nth, fault``: the first fault of each row, or none.

    Equal rows of a conversation meet by a hash of role and text beside the two themselves, so a
    conversation that holds a third of all rows is spread over the tasks.
    """
    equal = Window.partitionBy("conv_id", "dropped", F.xxhash64("role", "text"), "role", "text").orderBy(
        F.col("turn").asc_nulls_first()
    )

    def matches(pattern: str) -> Column:
        return F.col("text").rlike(pattern)

    return rows.withColumn("nth", F.row_number().over(equal)).withColumn(
        "fault",
        F.when(~matches(f"[^{_SPACES}]"), "blank").when(F.col("nth") > 1, "duplicate")
        .when(~matches(rf"[.!?][{_SPACES}]*\z"), "truncated"),
    )


def lightest(rows: list[tuple[str, bool, bool]], heads: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str]]:
    """Lightest weights of the items at the end of a segment, by state.

    ``rows`` are (initial, must be deleted, is truncated), ``heads`` the weights at its start. The
    last segment ends in the goal: the first accepting item that comes out is the only one.
    """
    agenda = [(cost, audit, 0, state) for state, (cost, audit) in heads.items()]
    heapq.heapify(agenda)
    final: set[tuple[int, int]] = set()
    ends: dict[int, tuple[int, str]] = {}
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == len(rows):
            if last and state in ACCEPTING:
                return {state: (cost, audit)}
            ends[state] = cost, audit
        legal = "a" if state == 2 else "u"
        heapq.heappush(agenda, (cost + INSERT, audit + "I", i, STEP[state, legal]))
        if i < len(rows):
            initial, delete, truncated = rows[i]
            heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, state))
            if not delete:
                more = cost + TRUNCATED * truncated
                heapq.heappush(agenda, (more + REROLE, audit + "R", i + 1, STEP[state, legal]))
                if (state, initial) in STEP:
                    heapq.heappush(agenda, (more + KEEP, audit + "K", i + 1, STEP[state, initial]))
    return ends


class Repair:
    """The repair of one conversation whose rows come one after the other."""

    def __init__(self):
        self.heads = {START: (0, "")}  # weights by state; audits without what is decided
        self.state = START  # where the decided edits lead
        self.audit: list[str] = []
        self.waiting: list[tuple[str, str]] = []  # rows of which nothing is decided
        self.rows: list[tuple[str, bool, bool]] = []
        self.cost = 0
        self.digest = hashlib.sha256()
        self.turns = 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.before: str | None = None
        self.first = self.newest = None
        self.distinct = 0

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> list[tuple]:
        """Take a row; returns the turns that are decided by now."""
        out = self.segment(False) if len(self.rows) == SEGMENT else []
        if fault:
            self.counts[fault] += 1
        self.counts["illegal"] += self.before is not None and self.before + role[:1] not in LEGAL
        self.before = role[:1]
        if turn is not None and turn != self.newest:
            self.first = turn if self.first is None else self.first
            self.newest = turn
            self.distinct += 1
        self.waiting.append((role, text))
        self.rows.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        return out

    def segment(self, last: bool) -> list[tuple]:
        """Derive the rows at hand; what all lightest items agree on is decided."""
        self.heads = lightest(self.rows, self.heads, last)
        self.rows = []
        sure = os.path.commonprefix([audit for _, audit in self.heads.values()])
        self.heads = {state: (cost, audit[len(sure) :]) for state, (cost, audit) in self.heads.items()}
        self.audit.append(sure)
        out, used = [], 0
        for letter in sure:
            role, text = "", ""
            if letter != "I":
                role, text = self.waiting[used]
                used += 1
            if letter == "D":
                continue
            if letter != "K":
                role = ROLES["a" if self.state == 2 else "u"]
            self.state = STEP[self.state, role[:1]]
            self.digest.update(f"{chr(10) if self.turns else ''}{role}:{text}".encode())
            out.append((self.turns, role, text, letter))
            self.turns += 1
        del self.waiting[:used]
        return out

    def finish(self) -> list[tuple]:
        out = self.segment(True)
        self.cost = next(cost for cost, _ in self.heads.values())
        return out

    def report(self) -> dict:
        gaps = 0 if self.first is None else self.newest - self.first + 1 - self.distinct
        return {
            "gaps": gaps, **self.counts, "cost": self.cost, "audit": "".join(self.audit),
            "repaired_sha256": self.digest.hexdigest(),
        }


REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
TURNS = "conv_id long, position long, role string, text string, edit string"
_BATCH = 4096


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    names, types = zip(*(field.split() for field in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names)
    )


def _repaired(rows: DataFrame, as_turns: bool, dropped: str | None) -> DataFrame:
    streamed = with_faults(_plain(rows, dropped)).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth"
    )
    schema = TURNS if as_turns else REPORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conversation, repair = None, None

        def done() -> None:
            turns = repair.finish()
            if as_turns:
                out.extend((conversation, *t) for t in turns)
            else:
                out.append((conversation, *repair.report().values()))

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "dropped"))
            for own, turn, role, text, fault, dropped in zip(*columns, strict=True):
                if repair is None or own != conversation:
                    if repair is not None:
                        done()
                    conversation, repair = own, Repair()
                if not dropped:
                    turns = repair.add(turn, role, text, fault)
                    if as_turns:
                        out.extend((conversation, *t) for t in turns)
                if len(out) >= _BATCH:
                    yield _table(schema, out)
                    out = []
        if repair is not None:
            done()
        yield _table(schema, out)

    return streamed.mapInArrow(run, schema)


def _plain(rows: DataFrame, dropped: str | None) -> DataFrame:
    mark = F.lit(False) if dropped is None else F.coalesce(F.col(f"`{dropped}`"), F.lit(False))
    return rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), mark.alias("dropped"),
    )


def repaired_turns(rows: DataFrame, dropped: str | None = None) -> DataFrame:
    """``conv_id, position, role, text, edit``: the turns of all repaired conversations.

    ``edit`` is K (kept), R (role changed) or I (inserted). Rows whose boolean column ``dropped``
    is true only name their conversation.
    """
    return _repaired(rows, True, dropped)


def reports(rows: DataFrame, dropped: str | None = None) -> DataFrame:
    """One row per conversation: faults, cost, audit and the digest of the repaired text."""
    return _repaired(rows, False, dropped)
