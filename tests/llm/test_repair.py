"""Conversation repair against a search over all edit sequences, and long conversations against short ones."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from claimweave.llm import conversations, repair

SCHEMA = "conv_id long, turn long, role string, text string"


def least(rows):
    """Cheapest repair of ``(role, text, fault)`` rows by Dijkstra over (row, initials' state), then all ties; (cost, audit, lines)."""
    best = {}
    heap = [(0, "", 0, "0", ())]
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in "0a":
            return cost, audit, lines
        if best.setdefault((i, state), (cost, audit)) < (cost, audit):
            continue
        due = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[due]
        heapq.heappush(heap, (cost + 5, audit + "I", i, due, (*lines, f"{name}:")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 * (fault == "truncated")
        first = role[:1]
        if first == due or (first == "s" and state == "0"):
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, first, (*lines, f"{role}:{text}")))
        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, due, (*lines, f"{name}:{text}")))


def expected(table):
    """The contract, row by row in plain Python."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in (r for r in table if r[0] == conv):
            f = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if f == 0:
                continue
            text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            rows += [(turn is not None, turn or 0, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
        rows.sort()
        seen, faults = set(), []
        for _, _, role, text in rows:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in rows if r[0]}
        cost, audit, lines = least([(r[2], r[3], f) for r, f in zip(rows, faults)])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_table(seed, conversations, most):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "what", "", " \t", None, "ok?", "a b. ", "long text\n", "é.", "x" * 3000]
    roles = ["user", "assistant"] * 4 + ["system", "tool", None, "", "s", "User"]
    rows = []
    for c in range(conversations):
        for turn in range(rnd.randint(1, most)):
            rows.append((None if c == 3 else c, rnd.choice([turn, turn, turn, turn + 2, None]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.6 else f"t{turn}."))
    return rows


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def answers(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_against_search(spark):
    table = random_table(5, 150, 14)
    df = spark.createDataFrame(table, SCHEMA).selectExpr("*", "1 AS code", "2 AS part", "'x' AS same").repartition(7)
    assert answers(conversations.damaged_and_repaired(df)) == expected(table)


@pytest.mark.parametrize("long", [1, 3, 16])
def test_stretches_give_the_same(spark, long):
    table = random_table(8, 12, 90)
    df = spark.createDataFrame(table, SCHEMA).repartition(3)
    whole = conversations.damaged(df)
    assert conversations.repaired(whole, long).count() > 5
    assert answers(conversations.repaired(whole, long)) == answers(conversations.repaired(whole))


def test_walk_of_a_long_stretch():
    rnd = random.Random(1)
    codes = bytes(rnd.choice([0, 1, 2, 3, 2, 3, 6, 7, 8]) for _ in range(3000))
    audit = "".join(a for a, _, _ in repair.walk(codes, repair.START, repair.FINAL, True))
    assert len(audit.replace("I", "")) == 3000
    stored = repair.checkpoints(codes, repair.FINAL, 1)
    spent = sum({"D": 2, "I": 5, "K": 0, "R": 1}[a] for a in audit)
    kept = [c for c, a in zip(codes, audit.replace("I", "")) if a != "D"]
    assert stored[0][repair.START] == spent + 5 * sum(c >> 2 & 1 for c in kept)


def test_empty_table_and_dropped_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.damaged_and_repaired(none).count() == 0
    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = answers(conversations.damaged_and_repaired(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
