"""Repair of conversation structure by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows read, state); the states say which role comes next in ``(s?(ua)+)?``.  Edits are its
edges: Keep and Rerole read a row and write one, Delete reads a row, Insert writes one.  A forward heap grows from the
first node and a reverse heap from the accepting ones; when they have met, every crossing of the same cost is finished
before the least audit, the string of edit initials, is taken.  Labels are (cost, least audit): of two audits that lead to one
node at one cost neither begins with the other, so the lesser one stays the lesser one whatever follows.

A long conversation is cut into segments.  Each is solved from every state that the segments before it may have left
to every state it may leave, and the labels are chained, so no task holds more texts than one segment's.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import name_of, schema_of

#: Nothing written, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
#: What a written user or assistant row leads to, and from where.
_TURN = (USER, USER, ASSISTANT, USER)
_TURN_FROM = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_KEPT_FROM = {c: {t: tuple(s for s in to if to[s] == t) for t in to.values()} for c, to in _KEPT.items()}
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
LEGAL = frozenset(("su", "ua", "au"))
#: Rows, and characters of text, of a segment.
ROWS, CHARACTERS = 256, 4 << 20
_SPACE = " \t\n\x0b\x0c\r"


def _out(rows: list[tuple[str, bool, bool]], i: int, s: int) -> Iterator[tuple[int, str, tuple[int, int]]]:
    yield INSERT, "I", (i, _TURN[s])
    if i < len(rows):
        initial, useless, cut = rows[i]
        yield DELETE, "D", (i + 1, s)
        if not useless:
            more = UNFINISHED * cut
            kept = _KEPT.get(initial, {}).get(s)
            if kept is not None:
                yield more, "K", (i + 1, kept)
            yield REROLE + more, "R", (i + 1, _TURN[s])


def _into(rows: list[tuple[str, bool, bool]], i: int, s: int) -> Iterator[tuple[int, str, tuple[int, int]]]:
    for before in _TURN_FROM.get(s, ()):
        yield INSERT, "I", (i, before)
    if i:
        initial, useless, cut = rows[i - 1]
        yield DELETE, "D", (i - 1, s)
        if not useless:
            more = UNFINISHED * cut
            for before in _KEPT_FROM.get(initial, {}).get(s, ()):
                yield more, "K", (i - 1, before)
            for before in _TURN_FROM.get(s, ()):
                yield REROLE + more, "R", (i - 1, before)


def cheapest(rows: list[tuple[str, bool, bool]], entry: int = START, goals: Iterable[int] = ACCEPTING) -> tuple[int, str] | None:
    """Least cost and its least audit from ``entry`` through all rows (role initial, must go, cut off) to a goal."""
    ahead, back = [(0, 0, "", entry)], [(0, -len(rows), "", g) for g in goals]  # cost, rows read, audit, state
    settled, settled_back = {}, {}
    best: tuple[int, str] | None = None

    def cross(cost: int, audit: str) -> None:
        nonlocal best
        if best is None or (cost, audit) < best:
            best = (cost, audit)

    far = float("inf")
    while ahead or back:
        top, top_back = ahead[0][0] if ahead else far, back[0][0] if back else far
        if best is not None and top + top_back > best[0]:
            break
        if top <= top_back:
            cost, i, audit, s = heappop(ahead)
            if (i, s) in settled:
                continue
            settled[i, s] = cost, audit
            if (i, s) in settled_back:
                cross(cost + settled_back[i, s][0], audit + settled_back[i, s][1])
            for more, letter, node in _out(rows, i, s):
                if node in settled_back:
                    cross(cost + more + settled_back[node][0], audit + letter + settled_back[node][1])
                if node not in settled:
                    heappush(ahead, (cost + more, node[0], audit + letter, node[1]))
        else:
            cost, i, audit, s = heappop(back)
            i = -i
            if (i, s) in settled_back:
                continue
            settled_back[i, s] = cost, audit
            if (i, s) in settled:
                cross(cost + settled[i, s][0], settled[i, s][1] + audit)
            for more, letter, node in _into(rows, i, s):
                if node in settled:
                    cross(cost + more + settled[node][0], settled[node][1] + letter + audit)
                if node not in settled_back:  # at one cost later rows first, as Keep may cost nothing and audits grow at their front
                    heappush(back, (cost + more, -node[0], letter + audit, node[1]))
    return best


def replay(audit: str, entry: int, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows written when the audit's edits are applied to (role, text) rows."""
    source, s = iter(rows), entry
    for letter in audit:
        if letter == "D":
            next(source)
            continue
        role, text = ("", "") if letter == "I" else next(source)
        if letter == "K":
            s = _KEPT[role[:1]][s]
        else:
            s = _TURN[s]
            role = "user" if s == USER else "assistant"
        yield letter, role, text


@dataclass
class _Label:
    """The best way to a state: cost, the audit's end that ways do not share yet, and the digest of what it wrote."""

    cost: int = 0
    audit: str = ""
    written: int = 0
    digest: object = field(default_factory=hashlib.sha256)

    def then(self, cost: int, audit: str, entry: int, rows: list[tuple[str, str]]) -> _Label:
        out = _Label(self.cost + cost, self.audit + audit, self.written, self.digest.copy())
        for _, role, text in replay(audit, entry, rows):
            out.digest.update(("\n" * bool(out.written) + f"{role}:{text}").encode())
            out.written += 1
        return out


class Repair:
    """One conversation: rows come in order, ``finish`` tells the verdict."""

    def __init__(self) -> None:
        self.labels = {START: _Label()}
        self.shared: list[str] = []
        self.rows: list[tuple[str, str]] = []
        self.lattice: list[tuple[str, bool, bool]] = []
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.before: str | None = None
        self.least = self.most = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if len(self.rows) >= ROWS or self.size > CHARACTERS:
            self._close_segment()
        if turn is not None and turn != self.most:
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        duplicate, truncated = duplicate and not blank, truncated and not blank and not duplicate
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        self.rows.append((role, text))
        self.lattice.append((initial, blank or duplicate, truncated))
        self.size += len(text)

    def _best(self, goals: tuple[int, ...]) -> _Label | None:
        ways = []
        for entry, label in self.labels.items():
            found = cheapest(self.lattice, entry, goals)
            if found:
                ways.append((label.cost + found[0], label.audit + found[1], entry, found))
        if not ways:
            return None
        _, _, entry, found = min(ways)
        return self.labels[entry].then(*found, entry, self.rows)

    def _close_segment(self) -> None:
        ends = {state: self._best((state,)) for state in range(4)}
        self.labels = {state: label for state, label in ends.items() if label}
        same = os.path.commonprefix([label.audit for label in self.labels.values()])
        self.shared.append(same)
        for label in self.labels.values():
            label.audit = label.audit[len(same):]
        self.rows, self.lattice, self.size = [], [], 0

    def finish(self) -> tuple:
        best = self._best(ACCEPTING)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost, "".join(self.shared) + best.audit, best.digest.hexdigest()


VERDICT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows: DataFrame, damage: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, again, live) with NULL role and text as one space, after the test damage that ``damage`` numbers.

    0 drops the row (it stays as one that is not ``live``, so that its conversation is known), 1 empties its text,
    2 removes ``.!?``, 3 repeats it, 4 makes it a user row; other numbers and None leave it alone.
    """
    kind = F.lit(None).cast("long") if damage is None else damage.cast("long")
    given = rows.select(
        name_of(conv_col).alias("conv"), name_of(turn_col).cast("long").alias("turn"), F.coalesce(name_of(role_col), F.lit(" ")).alias("role"),
        F.coalesce(name_of(text_col), F.lit(" ")).alias("text"), F.coalesce(kind, F.lit(-1).cast("long")).alias("kind"),
    )
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return given.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("again"), (F.col("kind") != 0).alias("live"),
    )


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows of a conversation together, by turn (NULL first), then role and text, with their faults; one shuffle."""
    from pyspark.sql import Window as W

    body = F.rtrim(F.col("text"), F.lit(_SPACE))
    same = F.when(F.col("live"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    faulty = rows.withColumns({"blank": F.length(body) == 0, "truncated": ~F.right(body, F.lit(1)).isin(".", "!", "?"), "same": same})
    dealt = faulty.repartition("conv")
    seen = F.row_number().over(W.partitionBy("conv", "same").orderBy(F.asc_nulls_first("turn"), "again")) > 1
    marked = dealt.withColumn("duplicate", seen).drop("same")
    return marked.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text", "duplicate")


def repair_conversations(rows: DataFrame, damage: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Faults, least cost, least audit and digest of the repaired rows of each conversation; one row for each id.

    A conversation's rows are taken by turn, NULL turns first, rows of one turn by role, then text, equal rows next to
    each other.  A row's first fault counts: blank, duplicate (role and text stand earlier), truncated.  Rows with a
    NULL id are one conversation; NULL roles and texts are one space; a conversation whose rows are all dropped has
    zeros, an empty audit and the digest of an empty text; an empty table gives an empty result; other columns
    are not read.  Rows of a conversation stream through one task in order, as one digest runs over all of them; what the task
    holds is a segment's rows and the audit, which is part of the result.
    """
    ordered = _in_order(damaged(rows, damage, conv_col, turn_col, role_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        conv_kind, now, repair, out = None, None, None, []

        def told() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], conv_kind)] + [pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)], ["conv", *VERDICT])

        for batch in batches:
            conv_kind = batch.column("conv").type
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "live", "blank", "duplicate", "truncated")]
            for conv, turn, role, text, live, blank, duplicate, truncated in zip(*columns, strict=True):
                if repair is None or conv != now:
                    if repair is not None:
                        out.append((now, *repair.finish()))
                    now, repair = conv, Repair()
                if live:
                    repair.add(turn, role, text, blank, duplicate, truncated)
            if len(out) >= 1000:
                yield told()
                out = []
        if repair is not None:
            out.append((now, *repair.finish()))
            yield told()

    kinds = schema_of(ordered, "conv") + ", " + ", ".join(f"{c} long" for c in VERDICT[:6]) + ", audit string, repaired_sha256 string"
    return ordered.select("conv", "turn", "role", "text", "live", "blank", "duplicate", "truncated").mapInArrow(run, kinds).withColumnRenamed("conv", conv_col)


def repaired_rows(rows: DataFrame, damage: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations themselves: conversation, ``place`` from 0, role, text, and the ``edit`` that wrote the row.

    The audits of ``repair_conversations`` go before the rows of their conversation, which are then replayed as a
    stream.  Same rules and cases; a conversation without repaired rows has no rows here.
    """
    given = damaged(rows, damage, conv_col, turn_col, role_col, text_col)
    verdicts = repair_conversations(rows, damage, conv_col, turn_col, role_col, text_col)
    live = _in_order(given).where("live").select("conv", F.lit(1).alias("part"), "turn", "role", "text", "duplicate")
    audits = verdicts.select(
        name_of(conv_col).alias("conv"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(False).alias("duplicate"),
    )
    together = audits.unionByName(live).repartition("conv").sortWithinPartitions("conv", "part", F.asc_nulls_first("turn"), "role", "text", "duplicate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for batch in batches:
                kinds.append(batch.column("conv").type)
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "role", "text")), strict=True)

        def told(out: list[tuple]) -> pa.RecordBatch:
            each = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(each[0], kinds[0]), pa.array(each[1], pa.int64()), *(pa.array(c, pa.string()) for c in each[2:])], ["conv", "place", "role", "text", "edit"],
            )

        kinds: list[pa.DataType] = []
        source, out, size = read(), [], 0
        row = next(source, None)
        while row:
            conv, audit = row[0], row[3]
            row = next(source, None)

            def own() -> Iterator[tuple[str, str]]:
                nonlocal row
                while row and row[1]:
                    role_and_text = row[2:]
                    row = next(source, None)
                    yield role_and_text

            for place, (edit, role, text) in enumerate(replay(audit, START, own())):
                out.append((conv, place, role, text, edit))
                size += len(text)
                if len(out) >= 1000 or size > CHARACTERS:
                    yield told(out)
                    out, size = [], 0
        if out:
            yield told(out)

    kinds = schema_of(together, "conv") + ", place long, role string, text string, edit string"
    found = together.select("conv", "part", "role", "text").mapInArrow(run, kinds)
    return found.select(name_of("conv").alias(conv_col), "place", F.col("role").alias(role_col), F.col("text").alias(text_col), "edit")
