"""Repair of conversation structure by the cheapest edits, one pass over each conversation in the order of its turns."""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator
from functools import cache
from tempfile import SpooledTemporaryFile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import WS

# What edits cost, and what a truncated row adds that stays.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
# Kinds of rows: by the initial of the role, and by the first fault.
INITIALS = "sua"
OTHER = len(INITIALS)
SOUND, BLANK, DUPLICATE, CUT = range(4)
# Places in the pattern (s?(ua)+)? : nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
# What an inserted or reroled row becomes at each place, and where that leads.
NEXT_ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
NEXT_PLACE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
# Bytes of one conversation that are held in memory; the rest lies in a file of the task until the conversation ends.
HELD_BYTES = 1 << 20

REPORT = (
    "conversation string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
TURNS = "conversation string, place long, role string, text string, edit string"


def _after_inserts(place: int, inserts: int) -> int:
    for _ in range(inserts):
        place = NEXT_PLACE[place]
    return place


def _kept_place(place: int, initial: int) -> int | None:
    """Where a row that keeps its role leads, or None where the pattern forbids it."""
    if initial == 0:
        return SYSTEM if place == START else None
    if initial == OTHER or NEXT_ROLE[place][0] != INITIALS[initial]:
        return None
    return NEXT_PLACE[place]


@cache
def _options(initial: int, fault: int) -> tuple[tuple[int, int, int, str], ...]:
    """(place before, place after, cost, edits) for everything that can happen around one row: inserts before it, then its own edit.

    Two inserts reach every place, and more only cost more.
    """
    out = []
    for place in range(4):
        for inserts in range(3):
            here, paid, said = _after_inserts(place, inserts), inserts * INSERT, "I" * inserts
            out.append((place, here, paid + DELETE, said + "D"))
            if fault in (BLANK, DUPLICATE):
                continue
            extra = TRUNCATED if fault == CUT else 0
            if (kept := _kept_place(here, initial)) is not None:
                out.append((place, kept, paid + extra, said + "K"))
            out.append((place, NEXT_PLACE[here], paid + REROLE + extra, said + "R"))
    return tuple(out)


class Steps:
    """The dynamic programme as an automaton.

    What decides the future of a conversation is, for each place, how much more it costs to be there than at the cheapest place, and the order
    of the edits that led there. There are few such situations. They are numbered as they are met, and a step is a look-up.

    Of edits that lead to one place at one cost, the ASCII-least are kept. Edits up to a row end with that row's own letter, so none of them
    begins another one, and whatever follows does not change their order.
    """

    def __init__(self) -> None:
        self.situations: list[tuple[tuple[int, int, int], ...]] = []  # (place, cost above the cheapest, rank) by place
        self.numbers: dict[tuple, int] = {}
        # For each step: the next situation, what the cheapest place has cost more, and by place (place before, edits).
        self.steps: list[tuple[int, int, dict[int, tuple[int, str]]]] = []
        self.taken: dict[tuple[int, int, int], int] = {}
        self.start = self._number(((START, 0, 0),))

    def _number(self, situation: tuple) -> int:
        n = self.numbers.setdefault(situation, len(self.situations))
        if n == len(self.situations):
            self.situations.append(situation)
        return n

    def step(self, situation: int, initial: int, fault: int) -> int:
        """Number of the step that a row of this kind makes."""
        key = (situation, initial, fault)
        n = self.taken.get(key)
        if n is None:
            n = self.taken[key] = len(self.steps)
            self.steps.append(self._work_out(*key))
        return n

    def _work_out(self, situation: int, initial: int, fault: int) -> tuple[int, int, dict[int, tuple[int, str]]]:
        at = {place: (cost, rank) for place, cost, rank in self.situations[situation]}
        best: dict[int, tuple[int, int, str, int]] = {}
        for before, after, cost, edits in _options(initial, fault):
            if before in at:
                found = (at[before][0] + cost, at[before][1], edits, before)
                best[after] = min(best.get(after, found), found)
        least = min(b[0] for b in best.values())
        ranks = {place: i for i, place in enumerate(sorted(best, key=lambda p: best[p][1:3]))}
        following = self._number(tuple((p, best[p][0] - least, ranks[p]) for p in sorted(best)))
        return following, least, {p: (b[3], b[2]) for p, b in best.items()}

    def end(self, situation: int) -> tuple[int, int, int]:
        """(cost, place, inserts) of the cheapest way to end: at no row, or after an assistant's."""
        ways = []
        for place, cost, rank in self.situations[situation]:
            for inserts in range(3):
                if _after_inserts(place, inserts) == ASSISTANT or (place == START and not inserts):
                    ways.append((cost + inserts * INSERT, rank, inserts, place))
        cost, _, inserts, place = min(ways)
        return cost, place, inserts


class _Conversation:
    """One conversation while its rows go by: counts, the situation, and spools of back-pointers and rows."""

    def __init__(self, steps: Steps, name: str | None) -> None:
        self.steps, self.name = steps, name
        self.situation, self.cost, self.rows = steps.start, 0, 0
        self.turns, self.first, self.last = 0, 0, 0
        self.faults, self.illegal, self.before = [0] * 4, 0, ""
        self.back = SpooledTemporaryFile(HELD_BYTES)
        self.texts = SpooledTemporaryFile(HELD_BYTES)

    def add(self, turn: int, numbered: bool, role: str, text: str, fault: int) -> None:
        if numbered:
            if not self.turns:
                self.first = turn
            self.turns += not self.turns or turn != self.last
            self.last = turn
        self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.rows > 0 and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        n = self.steps.step(self.situation, INITIALS.find(initial) if initial and initial in INITIALS else OTHER, fault)
        self.situation, paid, _ = self.steps.steps[n]
        self.cost += paid
        self.rows += 1
        self.back.write(struct.pack("=I", n))
        raw, said = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
        self.texts.write(struct.pack("=II", len(raw), len(said)) + raw + said)

    def _edits(self) -> tuple[list[str], bytearray, int]:
        """Ways to edit a row, the number of each row's way, and the inserts at the end, found by following the back-pointers from the last row."""
        cost, place, closing = self.steps.end(self.situation)
        self.cost += cost
        ways: list[str] = []
        chosen, numbers = bytearray(self.rows), {}
        block = 1 << 16
        for first in range((self.rows - 1) // block * block if self.rows else 0, -1, -block):
            self.back.seek(4 * first)
            held = array("I", self.back.read(4 * block))
            for i in range(len(held) - 1, -1, -1):
                place, edits = self.steps.steps[held[i]][2][place]
                n = numbers.setdefault(edits, len(ways))
                if n == len(ways):
                    ways.append(edits)
                chosen[first + i] = n
        return ways, chosen, closing

    def repaired(self, ways: list[str], chosen: bytearray, closing: int) -> Iterator[tuple[str, str, str]]:
        """(role, text, edit) of each row that the conversation has after the repair."""
        place = START
        self.texts.seek(0)
        for n in chosen:
            sizes = struct.unpack("=II", self.texts.read(8))
            role, text = (self.texts.read(s).decode("utf-8", "surrogatepass") for s in sizes)
            for edit in ways[n]:
                if edit == "D":
                    continue
                if edit == "K":
                    yield role, text, edit
                    place = SYSTEM if role[:1] == "s" else NEXT_PLACE[place]
                else:
                    yield NEXT_ROLE[place], "" if edit == "I" else text, edit
                    place = NEXT_PLACE[place]
        for _ in range(closing):
            yield NEXT_ROLE[place], "", "I"
            place = NEXT_PLACE[place]

    def report(self) -> tuple:
        ways, chosen, closing = self._edits()
        audit = "".join(map(ways.__getitem__, chosen)) + "I" * closing
        digest = hashlib.sha256()
        for i, (role, text, _) in enumerate(self.repaired(ways, chosen, closing)):
            digest.update(("\n" * (i > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.name, gaps, *self.faults[BLANK:], self.illegal, self.cost, audit, digest.hexdigest())

    def rows_after(self) -> Iterator[tuple]:
        for place, row in enumerate(self.repaired(*self._edits())):
            yield (self.name, place, *row)

    def close(self) -> None:
        self.back.close()
        self.texts.close()


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[_Conversation]:
    """The conversations of a partition, each when its last row has gone by; what is open is carried from batch to batch."""
    steps, now = Steps(), None
    for batch in batches:
        columns = (batch[c].tolist() for c in ("conversation", "present", "turn", "numbered", "role", "text", "fault"))
        for name, present, turn, numbered, role, text, fault in zip(*columns):
            if now is None or name != now.name:
                if now is not None:
                    yield now
                    now.close()
                now = _Conversation(steps, name)
            if present:
                now.add(turn, numbered, role, text, fault)
    if now is not None:
        yield now
        now.close()


def _reports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in REPORT.split(", ")]
    held: list[tuple] = []
    for conversation in _conversations(batches):
        held.append(conversation.report())
        if len(held) == 1000 or conversation.rows > HELD_BYTES:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def _turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in TURNS.split(", ")]
    held: list[tuple] = []
    size = 0
    for conversation in _conversations(batches):
        for row in conversation.rows_after():
            held.append(row)
            size += len(row[3]) + 1
            if len(held) == 10_000 or size > HELD_BYTES:
                yield pd.DataFrame(held, columns=names)
                held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def _streams(rows: DataFrame, present: Column) -> DataFrame:
    """Rows of a conversation in one partition, in the order of turns, each with its first fault."""
    fields = rows.select(
        F.col("conv_id").cast("string").alias("conversation"), present.alias("present"), F.col("turn").cast("long").alias("turn"),
        *[F.when(present, F.coalesce(F.col(c).cast("string"), F.lit(" "))).otherwise("").alias(c) for c in ("role", "text")])
    kept = F.rtrim("text", F.lit(WS))
    fields = fields.withColumn("last", F.right(kept, F.lit(1))).repartition("conversation")
    # Both orders are made inside the partitions of the conversations; the first one finds repeats by comparing whole texts.
    again = Window.partitionBy("conversation", "present", F.xxhash64("role", "text"), "role", "text").orderBy(F.asc_nulls_first("turn"))
    fault = (
        F.when(F.col("last") == "", BLANK).when(F.row_number().over(again) > 1, DUPLICATE)
        .when(~F.col("last").isin(".", "!", "?"), CUT).otherwise(SOUND))
    faulty = fields.withColumn("fault", fault).sortWithinPartitions("conversation", F.asc_nulls_first("turn"), "role", "text")
    return faulty.select(
        "conversation", "present", F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), F.col("turn").isNotNull().alias("numbered"), "role", "text", "fault")


def _as_given(out: DataFrame, rows: DataFrame) -> DataFrame:
    name = F.col("conversation").cast(rows.schema["conv_id"].dataType).alias("conv_id")
    return out.select(name, *[c for c in out.columns if c != "conversation"])


def repair_reports(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text): what is wrong with it, and the cheapest edits that mend it.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256. A row's first fault counts: no character but white space
    (blank); role and text seen earlier in the conversation (duplicate); last character other than white space not one of ``.!?`` (truncated). ``illegal``
    counts neighbours whose initials are not su, ua or au; ``gaps`` the whole numbers between the least and the greatest turn that no row has. Edits give the initials
    ``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (2), Delete (3; must be for blank and duplicate rows), Insert a row without text (2);
    a truncated row that stays adds 1. ``audit`` has the initials of the cheapest edits in order, the ASCII-least of equally cheap ones.

    Conversations are dealt by id and streamed in the order of turns (nulls first; rows of one turn by role, then text, so that repeated rows lie together).
    A task holds the situation of one conversation, and spools its back-pointers and rows, which leave memory beyond a megabyte; only the audit, which is
    a value of the result, grows in memory. A conversation is worked on by one task, since each row depends on those before it.

    Null roles and texts count as one space, null ids are one conversation, null turns come first and no gap counts them. Empty and very long texts
    need no care. Where ``present`` is false, a row only names its conversation. A conversation without present rows has zeros, an empty audit and the hash
    of the empty string. No rows give no rows; other columns are not read.
    """
    streams = _streams(rows, F.lit(True) if present is None else present)
    return _as_given(streams.mapInPandas(_reports, REPORT), rows)


def repaired_turns(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """The conversations after the edits that ``repair_reports`` tells of: conv_id, place (from 0), role, text and edit (K, R or I) of every row that is left."""
    streams = _streams(rows, F.lit(True) if present is None else present)
    return _as_given(streams.mapInPandas(_turns, TURNS), rows)
