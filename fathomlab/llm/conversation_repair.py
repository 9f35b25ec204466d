"""Repair of the turn structure of conversations by a stream of rows sorted within conversations.

A conversation should read ``(system? (user assistant)+)?``. Its rows are dealt out by conversation,
sorted by turn, and passed once: the state of a dynamic programme over the four places of that pattern
(nothing yet, after system, after user, after assistant) is carried from row to row and across Arrow
batches. For each place the cheapest edits so far are known by their cost, by their rank among the
others' edits in ASCII order, and by a running SHA-256 of the repaired text, so texts are never kept.
Costs relative to the least are small integers (a place that another can stand in for at a lower cost is
given up), so there are few states in all; a step from one to the next is looked up in a table that fills
itself. Of each row only the number of its step is kept, two bytes; from SPILL rows on they go to an
unnamed file of the task. The edits are read from them backwards at the end.

Why ranks suffice: cheapest edits to different places after equally many rows are never equal, and never
begin with one another, as each ends in the letter of the same row; so their order stays when letters follow.

Whether a row repeats an earlier one is decided before, by a window over (conversation, role, text).
A giant conversation is one task here, as SHA-256 and edits need its order, but one of constant memory beside
its backpointers' buffer and its result.

Defined results: a null role or text counts as one space; null turns come first and ties of turn go
by role and text; a null conv_id is a conversation of its own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

SPACES = " \t\n\x0b\x0c\r"
DAMAGE = 20
#: Backpointers of a conversation that are kept in memory (two bytes each).
SPILL = 1 << 20
#: Results that are handed on together.
ROWS_OUT = 2_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The place after a further message of user or assistant.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: b"user", ASSISTANT: b"assistant"}
#: What ends a conversation at each place.
_CLOSING = ("", "II", "I", "")
FINE, CUT, FAULTY = range(3)


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults put in by crc32(conv_id:turn) % 20: 0 drops the row,
    1 empties the text, 2 takes its end marks out, 3 repeats it, 4 makes it the user's."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(name.cast("binary")) % DAMAGE).alias("kind"))
    rows = rows.filter("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def _blank(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES)) == ""


def with_faults(rows: DataFrame) -> DataFrame:
    """The rows with ``fault``, the first that applies: blank, duplicate, truncated or null."""
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]).withColumn("blank", _blank(F.col("text")))
    # blank rows need no number, so their turn keeps them from piling up
    equal = Window.partitionBy("conv_id", "role", "text", F.when(F.col("blank"), F.col("turn"))).orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("seen", F.row_number().over(equal) > 1)
    ended = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1)).isin(".", "!", "?")
    return rows.select("conv_id", "turn", "role", "text", F.when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(~ended, "truncated").alias("fault"))


class Steps:
    """The dynamic programme's table: states are numbered as they come up, and so are the steps.

    A state is a tuple of (place, cost beyond the least), in ASCII order of the edits. A step has for each
    place it leads to the place before and the letters written."""

    def __init__(self):
        self.states: list[tuple] = [((NOTHING, 0),)]
        self.number = {self.states[0]: 0}
        self.known: dict[tuple[int, str, int], tuple[int, int, int]] = {}
        self.steps: list[dict[int, tuple[int, str]]] = []

    def take(self, state: int, initial: str, kind: int) -> tuple[int, int, int]:
        """Number of the step, number of the state after it, and what the least cost grows by."""
        key = (state, initial, kind)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self._make(self.states[state], initial, kind)
        return found

    def _make(self, state: tuple, initial: str, kind: int) -> tuple[int, int, int]:
        best: dict[int, tuple] = {}  # place -> cost, rank of the edits before, letters, place before

        def offer(place: int, cost: int, rank: int, letters: str, before: int) -> None:
            if place not in best or (cost, rank, letters) < best[place][:3]:
                best[place] = (cost, rank, letters, before)

        for rank, (place, cost) in enumerate(state):
            offer(place, cost + DELETE, rank, "D", place)
            if kind == FAULTY:
                continue
            more = TRUNCATED if kind == CUT else 0
            for inserted, at in (("", place), ("I", _NEXT[place])):
                spent = cost + more + INSERT * len(inserted)
                if initial == "s" and at == NOTHING:
                    offer(SYSTEM, spent + KEEP, rank, inserted + "K", place)
                if initial == "ua"[_NEXT[at] == ASSISTANT]:
                    offer(_NEXT[at], spent + KEEP, rank, inserted + "K", place)
                offer(_NEXT[at], spent + REROLE, rank, inserted + "R", place)
        kept = {p: b for p, b in best.items() if not self._hopeless(p, {q: c[0] for q, c in best.items()})}
        least = min(b[0] for b in kept.values())
        order = sorted(kept, key=lambda p: kept[p][1:3])
        after = tuple((p, kept[p][0] - least) for p in order)
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
        self.steps.append({p: (b[3], b[2]) for p, b in kept.items()})
        return len(self.steps) - 1, self.number[after], least

    @staticmethod
    def _hopeless(place: int, cost: dict[int, int]) -> bool:
        """Whether another place can follow every way on from here for less. A place that awaits a user stands in
        for another one, for NOTHING with one deletion (of a system message); an insertion leads to the other kind."""
        awaits_user = (NOTHING, SYSTEM, ASSISTANT)
        for q, c in cost.items():
            if q == place or (q == SYSTEM and place != USER):  # SYSTEM cannot end
                continue
            turn = 0 if (q in awaits_user) == (place in awaits_user) else INSERT
            if cost[place] > c + turn + (DELETE if place == NOTHING and q != NOTHING else 0):
                return True
        return False


class Trail:
    """Numbers of steps, two bytes each; beyond SPILL in a file without a name, which goes with the task."""

    def __init__(self):
        self.recent, self.file, self.blocks = array("H"), None, 0

    def add(self, step: int) -> None:
        self.recent.append(step)
        if len(self.recent) >= SPILL:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(self.blocks * SPILL * 2)
            self.recent.tofile(self.file)
            self.blocks, self.recent = self.blocks + 1, array("H")

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.recent)
        for k in reversed(range(self.blocks)):
            self.file.seek(k * SPILL * 2)
            block = array("H")
            block.fromfile(self.file, SPILL)
            yield from reversed(block)
        if self.file:
            self.file.close()


class Conversation:
    """What is carried while the rows of one conversation pass."""

    def __init__(self, conv: str | None, steps: Steps):
        self.conv, self.steps, self.state, self.cost = conv, steps, 0, 0
        self.hashes = {NOTHING: (hashlib.sha256(), b"")}  # and what comes before the next line
        self.trail = Trail()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.initial = 0, None
        self.turns, self.first, self.last = 0, None, None

    def row(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        if fault:
            self.faults[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        kind = FINE if fault is None else CUT if fault == "truncated" else FAULTY
        step, self.state, grown = self.steps.take(self.state, initial if initial in ("s", "u", "a") else "", kind)
        self.cost += grown
        self.trail.add(step)
        after, own, body = {}, role.encode("utf-8", "surrogatepass"), None
        for place, (before, letters) in self.steps.steps[step].items():
            old, gap = self.hashes[before]
            if letters == "D":
                after[place] = (old, gap)
                continue
            body = b":" + text.encode("utf-8", "surrogatepass") if body is None else body
            new = old.copy()
            if letters[0] == "I":
                new.update(gap + _ROLE[_NEXT[before]] + b":")
                gap = b"\n"
            new.update(gap + (own if letters[-1] == "K" else _ROLE[place]) + body)
            after[place] = (new, b"\n")
        self.hashes = after

    def result(self) -> tuple:
        ends = [(cost + INSERT * len(_CLOSING[place]), rank, place) for rank, (place, cost) in enumerate(self.steps.states[self.state])]
        more, _, place = min(ends)
        written, (total, gap), at = [_CLOSING[place]], self.hashes[place], place
        for _ in _CLOSING[place]:
            at = _NEXT[at]
            total.update(gap + _ROLE[at] + b":")
            gap = b"\n"
        for step in self.trail.backwards():
            place, letters = self.steps.steps[step][place]
            written.append(letters)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost + more, "".join(reversed(written)), total.hexdigest())


_COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_OUT = ", ".join(f"{c} {'string' if c in ('conv_id', 'audit', 'repaired_sha256') else 'long'}" for c in _COLUMNS)


def _pass(frames: Iterator) -> Iterator:
    """Frames of sorted rows (conv, turn, known, role, text, fault) to frames of results."""
    import pandas as pd

    steps, now, done, size = Steps(), None, [], 0
    for frame in frames:
        for conv, turn, known, role, text, fault in zip(*[frame[c].tolist() for c in ("conv", "turn", "known", "role", "text", "fault")]):
            if now is None or conv != now.conv:
                if now is not None:
                    done.append(now.result())
                    size += 1 + len(done[-1][-2]) // 1000
                    if size >= ROWS_OUT:
                        yield pd.DataFrame(done, columns=_COLUMNS)
                        done, size = [], 0
                now = Conversation(conv, steps)
            now.row(turn if known else None, role, text, fault)
    if now is not None:
        done.append(now.result())
        yield pd.DataFrame(done, columns=_COLUMNS)


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows of a conversation in one partition, sorted by turn; ids and turns in a form that frames keep exactly."""
    return (
        rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault").eqNullSafe("duplicate"))
        .select(F.col("conv_id").cast("string").alias("conv"), F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), F.col("turn").isNotNull().alias("known"), "role", "text", "fault")
    )


def repair_report(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256."""
    kind = rows.schema["conv_id"].dataType
    return _in_order(with_faults(rows)).mapInPandas(_pass, _OUT).withColumn("conv_id", F.col("conv_id").cast(kind))


def _apply(frames: Iterator) -> Iterator:
    """Frames of rows, each conversation's first one holding its edits in ``text``, to repaired rows."""
    import pandas as pd

    conv, edits, at, place, line = object(), "", 0, NOTHING, 0
    out: list[tuple] = []

    def put(role: str, text: str) -> None:
        nonlocal line
        out.append((conv, line, role, text))
        line += 1

    def inserts() -> None:
        nonlocal at, place
        while at < len(edits) and edits[at] == "I":
            at, place = at + 1, _NEXT[place]
            put(_ROLE[place].decode(), "")

    for frame in frames:
        for own, edit, role, text in zip(*[frame[c].tolist() for c in ("conv", "edit", "role", "text")]):
            if edit:
                conv, edits, at, place, line = own, text, 0, NOTHING, 0
                inserts()
                continue
            letter, at = edits[at], at + 1
            if letter == "K":
                place = SYSTEM if role[:1] == "s" else _NEXT[place]
                put(role, text)
            elif letter == "R":
                place = _NEXT[place]
                put(_ROLE[place].decode(), text)
            inserts()
        yield pd.DataFrame(out, columns=["conv_id", "line", "role", "text"])
        out.clear()


def repaired_rows(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The conversations after their repair: conv_id, line (from 0), role, text. ``report`` is
    :func:`repair_report` of the same rows; each conversation's edits travel as one row before its own."""
    kind = rows.schema["conv_id"].dataType
    faulty = with_faults(rows).withColumn("edit", F.lit(False))
    edits = report.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("string").alias("fault"), F.lit(True).alias("edit"))
    both = faulty.unionByName(edits).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("edit").desc(), F.col("turn").asc_nulls_first(), "role", "text", F.col("fault").eqNullSafe("duplicate")
    )
    done = both.select(F.col("conv_id").cast("string").alias("conv"), "edit", "role", "text").mapInPandas(_apply, "conv_id string, line long, role string, text string")
    return done.withColumn("conv_id", F.col("conv_id").cast(kind))


def repair_all(rows: DataFrame, spoilt: DataFrame) -> DataFrame:
    """:func:`repair_report` of ``spoilt`` for every conv_id of ``rows``; those without rows have zeros and
    empty edits."""
    report = repair_report(spoilt).withColumnRenamed("conv_id", "of")
    ids = rows.select("conv_id").distinct()
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COLUMNS[1:7]]
    return ids.join(report, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
