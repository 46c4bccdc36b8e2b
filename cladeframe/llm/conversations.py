"""Repair of conversation structure by a Viterbi search whose survivors coalesce.

The cheapest edits turn the roles of a conversation into `(s?(ua)+)?`, s, u and a being the
first letters of system, user and assistant. The rows of a conversation come in order; after
each there is at most one survivor for each of the four places in that pattern, and all of
them are leaves of one tree of back pointers. Nodes count what hangs on them: a branch that
no survivor stands on goes at once, and whatever all survivors share is final and leaves the
tree as edits. A survivor that another one undercuts, even after paying for the way to its place,
can win nothing and goes too; without that, the survivor that deletes everything would keep the
whole conversation open. Memory is the stretch that is still open, not the conversation. Of equally
cheap edits the smallest text wins; two survivors are compared over their whole open stretches.

An insert is put right before the row that follows it, or at the end. So after a row every
edit text ends in that row's own letter and has one such letter a row: of two different ones
none begins with the other, their first difference decides whatever follows, and one
survivor a place is enough.

Spark deals whole conversations, sorts them and marks faulty rows; a task reads its rows as a
stream. The order within one conversation makes it a stream of one task, however long it is,
but never a thing held in memory, except for the edit letters (one byte a row) where a report
asks for them.

Defined results: a null role or text is one space; rows are taken by turn, nulls first, then by
role and text; rows without a conv_id are one conversation; equal rows are duplicates of
the first. A role is known by its first letter, an empty role fits nowhere. Empty tables give
empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# White space, and the marks a complete text ends in.
BLANKS = " \t\n\x0b\x0c\r"
SENTENCE_END = "[.!?]"
NOT_BLANK = r"[^\x20\x09-\x0D]"
# What edits cost.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 3, 4, 3, 3
USER, ASSISTANT = "user", "assistant"
# Neighbours that the pattern allows.
NEIGHBOURS = {"su", "ua", "au"}
# Places in the pattern: nothing yet, after system, after user, after assistant.
EMPTY, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
# Where a letter leads.
FOLLOWS = {
    (EMPTY, "s"): AFTER_SYSTEM,
    (EMPTY, "u"): AFTER_USER,
    (AFTER_SYSTEM, "u"): AFTER_USER,
    (AFTER_ASSISTANT, "u"): AFTER_USER,
    (AFTER_USER, "a"): AFTER_ASSISTANT,
}
# The role that can be inserted, or given to a row, at a place.
FITTING = {EMPTY: USER, AFTER_SYSTEM: USER, AFTER_USER: ASSISTANT, AFTER_ASSISTANT: USER}
# What it costs at most to go on from the first place as one could from the second: inserts
# that lead there, and a delete of the system row that only an empty start may keep.
STANDS_IN = {
    (EMPTY, AFTER_SYSTEM): 0,
    (EMPTY, AFTER_USER): INSERT,
    (EMPTY, AFTER_ASSISTANT): 0,
    (AFTER_SYSTEM, EMPTY): max(2 * INSERT, DELETE),
    (AFTER_SYSTEM, AFTER_USER): INSERT,
    (AFTER_SYSTEM, AFTER_ASSISTANT): 2 * INSERT,
    (AFTER_USER, EMPTY): INSERT + DELETE,
    (AFTER_USER, AFTER_SYSTEM): INSERT,
    (AFTER_USER, AFTER_ASSISTANT): INSERT,
    (AFTER_ASSISTANT, EMPTY): DELETE,
    (AFTER_ASSISTANT, AFTER_SYSTEM): 0,
    (AFTER_ASSISTANT, AFTER_USER): INSERT,
}
# Most inserts in a row that can pay: a user and an assistant.
MOST_INSERTS = 2
# Rows of a result batch.
BATCH = 8192
LARGEST = 2**63 - 1

EDITS = "conv_id bigint, edit string, turn bigint, role string, text string, fault string"
REPORT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)


class Node:
    """One step of a survivor: the edits of a row, inserts before it included."""

    __slots__ = ("parent", "kids", "edits", "row", "roles")

    def __init__(self, parent: Node | None, edits: str, row: tuple | None, roles: list[str]):
        self.parent, self.edits, self.row, self.roles = parent, edits, row, roles
        self.kids = 0
        if parent is not None:
            parent.kids += 1


def open_stretch(a: Node, b: Node) -> tuple[str, str]:
    """The edits of two nodes of equal depth since they parted."""
    left, right = [], []
    while a is not b:
        left.append(a.edits)
        right.append(b.edits)
        a, b = a.parent, b.parent
    return "".join(reversed(left)), "".join(reversed(right))


class Repair:
    """The search over one conversation; `emit(node)` gets steps as soon as they are final."""

    def __init__(self, emit: Callable[[Node], None]):
        self.emit = emit
        self.final = Node(None, "", None, [])
        self.survivors: dict[int, tuple[int, Node]] = {EMPTY: (0, self.final)}

    def _choose(self, found: dict, place: int, cost: int, parent: Node, edits: str, roles: list) -> None:
        held = found.get(place)
        if held is not None:
            if held[0] < cost:
                return
            if held[0] == cost:
                ours, theirs = open_stretch(parent, held[1])
                if theirs + held[2] <= ours + edits:
                    return
        found[place] = (cost, parent, edits, roles)

    def _inserted(self, place: int) -> Iterator[tuple[int, list[str]]]:
        """Places that inserts lead to, with the inserted roles."""
        roles: list[str] = []
        yield place, roles
        for _ in range(MOST_INSERTS):
            roles = [*roles, FITTING[place]]
            place = FOLLOWS[place, roles[-1][0]]
            yield place, roles

    def step(self, row: tuple) -> None:
        """Take a row (turn, role, text, fault) in."""
        _, role, _, fault = row
        stays = fault not in ("blank", "duplicate")
        extra = LEFT_TRUNCATED if fault == "truncated" else 0
        found: dict[int, tuple[int, Node, str, list]] = {}
        for place, (cost, node) in self.survivors.items():
            for at, roles in self._inserted(place):
                paid, edits = cost + INSERT * len(roles), "I" * len(roles)
                self._choose(found, at, paid + DELETE, node, edits + "D", roles)
                if not stays:
                    continue
                kept = FOLLOWS.get((at, role[:1]))
                if kept is not None:
                    self._choose(found, kept, paid + extra, node, edits + "K", [*roles, role])
                given = FITTING[at]
                self._choose(
                    found, FOLLOWS[at, given[0]], paid + extra + REROLE, node, edits + "R", [*roles, given]
                )
        before = self.survivors
        self.survivors = {
            p: (cost, Node(parent, edits, row, roles))
            for p, (cost, parent, edits, roles) in found.items()
            if all(q == p or found[q][0] + STANDS_IN[q, p] >= cost for q in found)
        }
        for _, node in before.values():
            self._release(node)
        self._settle()

    def _release(self, node: Node) -> None:
        """Drop a branch that no survivor stands on."""
        while node.kids == 0 and node is not self.final:
            node.parent.kids -= 1
            node = node.parent

    def _settle(self) -> None:
        """Emit what all survivors share."""
        if self.final.kids != 1:
            return
        path = []
        node = next(iter(self.survivors.values()))[1]
        while node is not self.final:
            path.append(node)
            node = node.parent
        standing = {id(n) for _, n in self.survivors.values()}
        while path and self.final.kids == 1 and id(self.final) not in standing:
            self.final = path.pop()
            self.final.parent = None
            self.emit(self.final)

    def finish(self) -> int:
        """End the conversation: emit all that is left and return the cost."""
        found: dict = {}
        for place, (cost, node) in self.survivors.items():
            for at, roles in self._inserted(place):
                if at in (EMPTY, AFTER_ASSISTANT):
                    # All ends compete with each other, so they are held at one place.
                    self._choose(found, EMPTY, cost + INSERT * len(roles), node, "I" * len(roles), roles)
                    break
        cost, node, edits, roles = found[EMPTY]
        path = []
        while node is not self.final:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.emit(node)
        if edits:
            self.emit(Node(None, edits, None, roles))
        return cost


def _marked(rows: DataFrame, gone: Column | None) -> DataFrame:
    """Rows of whole conversations, dealt and sorted, with their first fault.

    One shuffle, by conversation; what needs another order is sorted in place.
    """
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"),
    )
    again = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("gone"), F.col("turn").asc_nulls_first())
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = (
        F.when(F.col("gone"), "gone")
        .when(~F.col("text").rlike(NOT_BLANK), "blank")
        .when(F.row_number().over(again) > 1, "duplicate")
        .when(~last.rlike(SENTENCE_END), "truncated")
    )
    return (
        plain.repartition("conv_id")
        .withColumn("fault", fault)
        .drop("gone")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault").asc_nulls_first())
    )


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Conversations of a sorted stream, each as (conv_id, stream of rows)."""
    rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
    held = next(rows, None)

    while held is not None:
        conv = held[0]

        def own() -> Iterator[tuple]:
            nonlocal held
            while held is not None and held[0] == conv:
                yield held[1:]
                held = next(rows, None)

        yield conv, own()


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    arrow = pa.schema([(name, pa.int64() if kind == "bigint" else pa.string()) for name, kind in fields])
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield made()
            held = []
    if held:
        yield made()


def _edit_rows(node: Node) -> list[tuple]:
    """A final step as rows: edit, turn, role, text, fault."""
    turn, _, text, fault = node.row or (None, None, None, None)
    out = []
    for i, edit in enumerate(node.edits):
        if edit == "I":
            out.append(("I", None, node.roles[i], "", None))
        else:
            out.append((edit, turn, None if edit == "D" else node.roles[-1], None if edit == "D" else text, fault))
    return out


def repair_edits(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """The edits of every conversation in order: conv_id, edit, turn, role, text, fault.

    `edit` is K(eep), R(erole), D(elete) or I(nsert); role and text are those after it, null for
    what is deleted. Rows of one conversation stand in order within one partition. `gone` marks
    rows that count as absent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edits() -> Iterator[tuple]:
            for conv, own in _conversations(batches):
                ready: list[tuple] = []
                search = Repair(lambda node: ready.extend(_edit_rows(node)))
                for row in own:
                    if row[3] != "gone":
                        search.step(row)
                    yield from ((conv, *r) for r in ready)
                    ready.clear()
                search.finish()
                yield from ((conv, *r) for r in ready)

        yield from _batches(edits(), EDITS)

    return _marked(rows, gone).mapInArrow(run, EDITS)


class Tally:
    """What a report says of a conversation, kept while its rows go by."""

    def __init__(self):
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.turns = 0, 0
        self.first = self.last = self.before = None
        self.audit: list[str] = []
        self.digest, self.any_line = hashlib.sha256(), False

    def see(self, row: tuple) -> None:
        turn, role, _, fault = row
        if fault is not None:
            self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in NEIGHBOURS:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn

    def take(self, node: Node) -> None:
        self.audit.append(node.edits)
        for edit, _, role, text, _ in _edit_rows(node):
            if edit != "D":
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                self.digest.update(b"\n" + line if self.any_line else line)
                self.any_line = True

    def row(self, cost: int) -> tuple:
        gaps = 0 if self.first is None else min(LARGEST, self.last - self.first + 1 - self.turns)
        return (gaps, *self.faults.values(), self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


def repair_report(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `gone` marks rows that count as absent; a conversation without other rows has zeros, an
    empty audit and the hash of nothing. gaps counts turns missing between the first and the last,
    2^63 - 1 at most. Faults and illegal neighbours are those before the repair; audit is the edit
    letters in order; the hash is that of the repaired `role:text` lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reports() -> Iterator[tuple]:
            for conv, own in _conversations(batches):
                tally = Tally()
                search = Repair(tally.take)
                for row in own:
                    if row[3] != "gone":
                        tally.see(row)
                        search.step(row)
                yield conv, *tally.row(search.finish())

        yield from _batches(reports(), REPORT)

    return _marked(rows, gone).mapInArrow(run, REPORT)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by the crc32 of `conv_id:turn` modulo 20: conv_id, turn, role, text, gone.

    0 marks a row as gone, 1 empties its text, 2 takes its sentence marks out, 3 repeats it, 4 makes
    its role user. Nulls read as one space.
    """

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    coded = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(
        F.col("code") == 2, F.regexp_replace("text", SENTENCE_END, "")
    )
    return coded.select(
        "conv_id",
        "turn",
        F.when(F.col("code") == 4, USER).otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        (F.col("code") == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
