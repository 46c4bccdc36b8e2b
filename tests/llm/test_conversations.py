"""Conversation repair against a search of all edits, and its edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cladeframe.llm.conversations import Repair, damaged, repair_edits, repair_report

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    """Rows (conv, turn, role, text) after damage."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(name.encode()) % 20
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out


def faults(rows):
    """The first fault of each (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif bare[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append(None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) by trying all edits, cheapest first and then by letters."""
    marks = faults(rows)
    best = None
    slots = [("", []), ("I", ["user"]), ("I", ["assistant"]), ("II", ["user", "assistant"]), ("II", ["assistant", "user"])]

    def options(row, mark):
        _, role, text = row
        yield "D", 4, []
        if mark not in ("blank", "duplicate"):
            extra = 3 if mark == "truncated" else 0
            yield "K", extra, [(role, text)]
            for new in ("user", "assistant"):
                yield "R", 3 + extra, [(new, text)]

    for edits in itertools.product(*(list(options(r, m)) for r, m in zip(rows, marks, strict=True))):
        base = sum(e[1] for e in edits)
        if best is not None and base > best[0]:
            continue
        for inserts in itertools.product(slots, repeat=len(rows) + 1):
            cost = base + sum(3 * len(a) for a, _ in inserts)
            if best is not None and cost > best[0]:
                continue
            audit, lines = "", []
            for i, (letters, roles) in enumerate(inserts):
                audit += letters
                lines += [(r, "") for r in roles]
                if i < len(rows):
                    audit += edits[i][0]
                    lines += edits[i][2]
            if LEGAL.match("".join(r[:1] for r, _ in lines)) and all(r for r, _ in lines):
                if best is None or (cost, audit) < best[:2]:
                    best = (cost, audit, lines)
    return best


def report(rows):
    """The whole report of one conversation's rows (turn, role, text), in order."""
    marks = faults(rows)
    cost, audit, lines = cheapest(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    counts = [marks.count(m) for m in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def invented(seed, conversations, most=4):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "student", None]
    texts = ["Yes.", "No!", "and then", "", " \t", "Is it? ", "Yes.", None, "é?\n"]
    rows = []
    for conv in range(conversations):
        for _ in range(rng.randint(1, most)):
            turn = rng.choice([None, *range(6)])
            rows.append((conv, turn, rng.choice(roles[: rng.choice([2, 3, 7])]), rng.choice(texts)))
    return rows


def test_report_is_the_cheapest_repair(spark):
    rows = invented(5, 120) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho.")]
    found = repair_report(spark.createDataFrame(rows, SCHEMA))
    expected = []
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        expected.append((conv, *report(in_order(own))))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_damaged_report_returns_every_conversation(spark):
    rows = invented(7, 80, most=3) + [(900, 0, "user", None), (None, None, None, None)]
    hidden = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:3".encode()) % 20 == 0)
    rows.append((hidden, 3, "user", "Gone."))
    hurt = damaged(spark.createDataFrame(rows, SCHEMA))
    found = {r[0]: tuple(r)[1:] for r in repair_report(hurt, F.col("gone")).collect()}
    after = damage(rows)
    assert set(found) == {r[0] for r in rows}
    for conv, got in found.items():
        assert got == report(in_order([r[1:] for r in after if r[0] == conv]))
    assert found[hidden] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_edits_give_the_repaired_conversation(spark):
    rows = invented(11, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    edits = {}
    for r in repair_edits(df).collect():
        edits.setdefault(r["conv_id"], []).append(r)
    for r in repair_report(df).collect():
        own = edits[r["conv_id"]]
        assert "".join(e["edit"] for e in own) == r["audit"]
        lines = [f"{e['role']}:{e['text']}" for e in own if e["edit"] != "D"]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == r["repaired_sha256"]
        assert LEGAL.match("".join(e["role"][0] for e in own if e["edit"] != "D"))


def test_open_stretch_stays_short():
    """A clean conversation of many rows leaves the tree as it goes."""
    emitted = []
    search = Repair(emitted.append)
    longest = 0
    for i in range(20_000):
        search.step((i, "user" if i % 2 == 0 else "assistant", f"{i}.", None))
        longest = max(longest, i + 1 - len(emitted))
    assert search.finish() == 0
    assert len(emitted) == 20_000
    assert longest < 50


def test_long_conversation_with_faults_in_one_stream(spark):
    """One conversation that owns nearly all rows, against a plain table of costs."""
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"{i}" + rng.choice([".", "", "!"])) for i in range(5000)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    found = {r["conv_id"]: r for r in repair_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    state = {0: 0}
    fits = {0: "u", 1: "u", 2: "a", 3: "u"}
    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def inserted(costs):
        costs = dict(costs)
        for _ in range(2):
            for p, c in list(costs.items()):
                q = to[p, fits[p]]
                costs[q] = min(costs.get(q, 10**9), c + 3)
        return costs

    for _, _, role, text in rows[:5000]:
        extra = 0 if text[-1] in ".!?" else 3
        new = {}
        for p, c in inserted(state).items():
            new[p] = min(new.get(p, 10**9), c + 4)
            for letter, paid in ((role[0], 0), (fits[p], 3)):
                q = to.get((p, letter))
                if q is not None:
                    new[q] = min(new.get(q, 10**9), c + extra + paid)
        state = new
    end = inserted(state)
    assert found[1]["cost"] == min(end.get(0, 10**9), end.get(3, 10**9))
    assert sum(x != "I" for x in found[1]["audit"]) == 5000
    assert found[2]["audit"] == "KK"


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(None, 2**63 - 1, "user", "a."), (None, -(2**63), "user", "b.")]])
def test_edges(spark, rows):
    found = repair_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len({r[0] for r in rows})
    for r in found:
        assert r["gaps"] >= 0


def test_other_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.")], SCHEMA).selectExpr(
        "*", "'x' AS fault", "'x' AS gone", "'x' AS code", "'x' AS copy", "'x' AS audit", "'x' AS edit"
    )
    assert repair_report(df).first()["audit"] == "KI"
    assert repair_report(damaged(df), F.col("gone")).count() == 1
