"""Operator 12: conversation repair by two sorted streams and a small dynamic program.

A conversation's turns are edited at least cost so that their roles read as an optional system
turn and then pairs of a user's and an assistant's turn. The rows of a conversation meet in one
partition, sorted by turn. The first stream reads them backwards and carries the cost to the end
from each of four places of the role pattern; its decisions leave as one number a row, the
compact backpointer, which Spark's sorter holds and spills like any column. The second stream
reads the rows forwards and follows the decisions. Both carry their state across Arrow batches
and hold a batch at a time, so a conversation of any length needs bounded memory, and a lost
executor costs a recomputed partition and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Costs of the edits. A truncated turn that stays costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: White space: blank and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("none", "blank", "duplicate", "truncated", "gone")
#: Places of the role pattern: nothing yet, after the system's, a user's or an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Place after a turn by a user or an assistant where the pattern wants it.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Least cost to the end where no rows are left.
END = (0, 2 * INSERT, INSERT, 0)
EDITS = "DIKR"  # in the order that decides between equal costs


class Edit(NamedTuple):
    """One edit: the row it was made for (null for a row's insertions after the last one) and the turn that it leaves."""

    conversation: str | None
    letter: str
    role: str | None
    text: str | None


class Row(NamedTuple):
    conversation: str | None
    turn: int
    no_turn: bool
    role: str | None
    text: str | None
    kind: int
    plan: int


def kept_place(place: int, initial: int) -> int | None:
    """Place after a kept turn whose role begins with s, u, a (0, 1, 2) or else (3); none if the pattern forbids it."""
    if initial == 0:
        return SYSTEM if place == START else None
    return NEXT[place] if initial < 3 and NEXT[place] == (USER, ASSISTANT)[initial - 1] else None


def step(after: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], int]:
    """Costs before a row, less the cost from START, and the row's decisions: an index of EDITS per place, two bits each."""
    fault, initial = divmod(kind, 4)
    direct = []
    for place in range(4):
        options = [(DELETE + after[place], 0)]
        if FAULTS[fault] not in ("blank", "duplicate"):
            more = TRUNCATED if FAULTS[fault] == "truncated" else 0
            kept = kept_place(place, initial)
            if kept is not None:
                options.append((KEEP + more + after[kept], 2))
            options.append((REROLE + more + after[NEXT[place]], 3))
        direct.append(min(options))
    # Insertions lead from any place to USER and between USER and ASSISTANT; two of them never lead back cheaper.
    costs = [0, 0, *(min(direct[a][0], INSERT + direct[b][0]) for a, b in ((USER, ASSISTANT), (ASSISTANT, USER)))]
    for place in (START, SYSTEM):
        costs[place] = min(direct[place][0], INSERT + costs[USER])
    plan = 0
    for place in range(4):
        plan |= min(direct[place], (INSERT + costs[NEXT[place]], 1))[1] << (2 * place)
    return tuple(c - costs[START] for c in costs), plan


def conversation_rows(rows: DataFrame) -> DataFrame:
    """Sorted rows of whole conversations with a fault each: conversation, turn, no_turn, role, text, kind, copy.

    Within a conversation rows go by turn, nulls first, rows of one turn by role and text. The
    fault is the first that holds: blank (only white space), duplicate (role and text of an
    earlier row), truncated (ends neither in ``.`` nor ``!`` nor ``?``). Null roles and
    texts count as one blank. A row with ``gone`` true marks its conversation and is no turn.
    """
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    text = F.when(~gone, F.coalesce("text", F.lit(" ")))
    read = rows.select(
        F.col("conv_id").cast("string").alias("conversation"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.col("turn").isNull().alias("no_turn"),
        F.when(~gone, F.coalesce("role", F.lit(" "))).alias("role"),
        text.alias("text"),
        gone.alias("gone"),
    )
    met = read.repartition("conversation")
    # The rows already lie together by conversation, so this window sorts and does not shuffle.
    copies = W.partitionBy("conversation", "role", "text").orderBy(F.desc("no_turn"), "turn")
    counted = met.withColumn("copy", F.row_number().over(copies))
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    fault = (
        F.when(F.col("gone"), FAULTS.index("gone"))
        .when(last == "", FAULTS.index("blank"))
        .when(F.col("copy") > 1, FAULTS.index("duplicate"))
        .when(~last.isin(".", "!", "?"), FAULTS.index("truncated"))
        .otherwise(0)
    )
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return counted.withColumn("kind", fault * 4 + initial).drop("gone")


_ORDER = ("turn", "role", "text", "copy")
_ROW = "conversation string, turn long, no_turn boolean, role string, text string, kind int, copy int, plan int"


def planned(rows: DataFrame) -> DataFrame:
    """``conversation_rows`` with the decisions of each row, sorted forwards in each partition."""
    backwards = [F.desc("conversation"), F.asc("no_turn"), *[F.desc(c) for c in _ORDER]]
    forwards = [F.asc("conversation"), F.desc("no_turn"), *[F.asc(c) for c in _ORDER]]
    decided = rows.sortWithinPartitions(*backwards).mapInPandas(_decide, _ROW)
    return decided.sortWithinPartitions(*forwards)


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[tuple, tuple] = {}  # costs differ by less than ten, so few pairs exist
    current, costs = object(), END
    gone = FAULTS.index("gone")
    for batch in batches:
        plans = []
        for conversation, kind in zip(batch["conversation"].tolist(), batch["kind"].tolist()):
            if conversation != current:
                current, costs = conversation, END
            if kind // 4 == gone:
                plans.append(0)
                continue
            found = known.get((costs, kind))
            if found is None:
                found = known[costs, kind] = step(costs, kind)
            costs, plan = found
            plans.append(plan)
        yield batch.assign(plan=pd.Series(plans, batch.index, "int32"))


def walk(rows: Iterator[Row]) -> Iterator[tuple[Row | None, list[Edit]]]:
    """Each row with its edits, in order. After the last row of a conversation follow its closing insertions, without a row."""
    gone = FAULTS.index("gone")
    current, place, begun = None, START, False
    for row in rows:
        if begun and row.conversation != current:
            yield None, _closing(current, place)
            place = START
        current, begun = row.conversation, True
        edits: list[Edit] = []
        while row.kind // 4 != gone:
            letter = EDITS[row.plan >> (2 * place) & 3]
            if letter == "D":
                edits.append(Edit(current, "D", None, None))
                break
            place = kept_place(place, row.kind % 4) if letter == "K" else NEXT[place]
            if letter != "I":
                edits.append(Edit(current, letter, row.role if letter == "K" else NAMES[place], row.text))
                break
            edits.append(Edit(current, "I", NAMES[place], ""))
        yield row, edits
    if begun:
        yield None, _closing(current, place)


def _closing(conversation: str | None, place: int) -> list[Edit]:
    edits = []
    while END[place]:
        place = NEXT[place]
        edits.append(Edit(conversation, "I", NAMES[place], ""))
    return edits


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[Row]:
    for batch in batches:
        columns = [batch[c].tolist() for c in Row._fields]
        yield from map(Row._make, zip(*columns))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, edit (I, K or R), role, text.

    Any frame with conv_id, turn, role and text; other columns are not read.
    """
    named = "conversation string, position long, edit string, role string, text string"

    def turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size, position = [], 0, 0
        for row, edits in walk(_rows(batches)):
            for edit in edits:
                if edit.letter != "D":
                    out.append((edit.conversation, position, edit.letter, edit.role, edit.text))
                    position, size = position + 1, size + len(edit.text or "") + 50
            if row is None:
                position = 0
            if size > 1 << 22:
                yield pd.DataFrame(out, columns=_names(named))
                out, size = [], 0
        yield pd.DataFrame(out, columns=_names(named))

    found = planned(conversation_rows(rows)).mapInPandas(turns, named)
    return found.select(F.col("conversation").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *_names(named)[1:])


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


_AUDIT = (
    "conversation string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: what was wrong, the edits, their cost and a digest of the repaired turns.

    Columns: conv_id, gaps (turn numbers between the least and the largest that no row has),
    blank, duplicate, truncated (rows by first fault), illegal (neighbours whose roles do not
    begin with su, ua or au), cost, audit (initials of the edits), repaired_sha256 (of
    ``role:text`` lines). Null ids are one conversation; a conversation whose rows are all
    ``gone`` has zeros, an empty audit and the digest of nothing. An empty table gives no row.
    """
    found = planned(conversation_rows(rows)).mapInPandas(_audit, _AUDIT)
    return found.select(F.col("conversation").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *_names(_AUDIT)[1:])


def _audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out, size = [], 0
    costs = {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}
    seen = _Seen()
    for row, edits in walk(_rows(batches)):
        if row is not None:
            seen.conversation = row.conversation
            seen.take(row)
        for edit in edits:
            seen.audit.append(edit.letter)
            seen.cost += costs[edit.letter]
            if edit.letter in "KR" and FAULTS[row.kind // 4] == "truncated":
                seen.cost += TRUNCATED
            if edit.letter != "D":
                seen.digest.update(f"{seen.mark}{edit.role}:{edit.text}".encode())
                seen.mark = "\n"
        if row is None:
            out.append(seen.row())
            size += len(out[-1][-2]) + 100
            seen = _Seen()
            if size > 1 << 22:
                yield pd.DataFrame(out, columns=_names(_AUDIT))
                out, size = [], 0
    yield pd.DataFrame(out, columns=_names(_AUDIT))


class _Seen:
    """What the second stream carries of a conversation."""

    def __init__(self):
        self.conversation, self.last_role = None, None
        self.least = self.largest = None
        self.turns = self.illegal = self.cost = 0
        self.faults = [0] * len(FAULTS)
        self.audit = _Letters()
        self.digest, self.mark = hashlib.sha256(), ""

    def take(self, row: Row) -> None:
        fault, initial = divmod(row.kind, 4)
        if FAULTS[fault] == "gone":
            return
        self.faults[fault] += 1
        if self.last_role is not None and (self.last_role, initial) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.last_role = initial
        if not row.no_turn and row.turn != self.largest:  # turns come in order
            self.least = row.turn if self.least is None else self.least
            self.largest = row.turn
            self.turns += 1

    def row(self) -> tuple:
        gaps = self.largest - self.least + 1 - self.turns if self.turns else 0
        none, blank, duplicate, truncated, gone = self.faults
        audit = self.audit.text()
        return (self.conversation, gaps, blank, duplicate, truncated, self.illegal, self.cost, audit, self.digest.hexdigest())


class _Letters:
    """The audit of a conversation, one byte a letter however long."""

    def __init__(self):
        self._bytes = bytearray()

    def append(self, letter: str) -> None:
        self._bytes += letter.encode()

    def text(self) -> str:
        return self._bytes.decode()


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by a checksum of conversation and turn, columns conv_id, turn, role, text, gone.

    Of twenty remainders 0 drops the row (it stays as a mark, ``gone``), 1 empties its text, 2
    removes ``. ! ?``, 3 repeats the row, 4 makes it the user's. Nulls count as one blank.
    """
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat_ws(":", *name)) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    spoilt = rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fault == 0).alias("gone"),
        F.when(fault == 3, 2).otherwise(1).alias("times"),
    )
    return spoilt.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "time")


def conversations_to_audits(conversations: DataFrame) -> DataFrame:
    """Audits of the damaged conversations."""
    return audits(damaged(conversations))
