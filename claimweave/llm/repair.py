"""The cheapest repair of one stretch of a conversation, by a square-root checkpointed dynamic program.

The structure wanted is ``(s?(ua)+)?`` over role initials, an automaton of four states. Rows come as small codes. The backward
costs (one per state) are stored at every ``sqrt(n)``-th row only; the walk forward recomputes one block of them
at a time and takes the first edit, in ASCII order, that still reaches the least cost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

#: States: nothing yet, after s, after u, after a. FAR stands for impossible.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES, ACCEPTING, FAR = 4, (START, AFTER_A), 1 << 60
#: The state that a turn of the user or assistant leads to, whichever is due.
DUE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A row's code: its initial (0 other, 1 s, 2 u, 3 a) + 4 if truncated, or GONE if it has to be deleted.
GONE = 8
END_COSTS = tuple(0 if q in ACCEPTING else FAR for q in range(STATES))


def kept_to(code: int, state: int) -> int | None:
    """The state after keeping a row, or None where its role is not due."""
    initial = code & 3
    if initial == 1:
        return AFTER_S if state == START else None
    to = DUE[state]
    return to if initial and initial == (2 if to == AFTER_U else 3) else None


#: For each code and state, ``(state after, cost)`` of keep and of rerole; None where not allowed.
KEEP = [[None if c == GONE or kept_to(c, q) is None else (kept_to(c, q), TRUNCATED * (c >> 2)) for q in range(STATES)] for c in range(9)]
RENAME = [[None if c == GONE else (DUE[q], REROLE + TRUNCATED * (c >> 2)) for q in range(STATES)] for c in range(9)]


def with_inserts(costs: list[int]) -> list[int]:
    """Costs when turns may be inserted first. Inserting more than three never pays: a fourth would come back to a state."""
    for _ in range(3):
        costs = [min(costs[q], INSERT + costs[DUE[q]]) for q in range(STATES)]
    return costs


def before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Backward costs in front of a row from those behind it."""
    out = []
    for q in range(STATES):
        best = DELETE + after[q]
        for edit in (KEEP[code][q], RENAME[code][q]):
            if edit is not None and edit[1] + after[edit[0]] < best:
                best = edit[1] + after[edit[0]]
        out.append(best)
    return tuple(min(c, FAR) for c in with_inserts(out))


def closed(after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs at the end of a conversation, where turns may still be inserted."""
    return tuple(min(c, FAR) for c in with_inserts(list(after)))


FINAL = closed(END_COSTS)


def across(codes: bytes) -> list[list[int]]:
    """Least costs of a stretch from each state to each state (min-plus matrix), inserts in front of its rows included."""
    columns = []
    for to in range(STATES):
        costs = tuple(0 if q == to else FAR for q in range(STATES))
        for code in reversed(codes):
            costs = before(code, costs)
        columns.append(costs)
    return [[columns[to][q] for to in range(STATES)] for q in range(STATES)]


def checkpoints(codes: bytes, after: tuple[int, ...], step: int) -> dict[int, tuple[int, ...]]:
    """Backward costs at every ``step``-th row and at the end."""
    stored, costs = {len(codes): after}, after
    for i in range(len(codes) - 1, -1, -1):
        costs = before(codes[i], costs)
        if i % step == 0:
            stored[i] = costs
    return stored


def walk(codes: bytes, state: int, after: tuple[int, ...], last: bool) -> Iterator[tuple[str, int | None, int]]:
    """The edits ``(letter, row or None, state after)`` of the ASCII-least cheapest repair from ``state``.

    ``after`` are the backward costs behind the stretch; ``last``: the conversation ends there.
    """
    n = len(codes)
    step = max(1, math.isqrt(n))
    stored = checkpoints(codes, after, step)
    block: list[tuple[int, ...]] = []
    low = -1
    i = 0
    costs = stored[0]
    while i < n or (last and state not in ACCEPTING):
        if i < n and i // step != low:
            low = i // step
            high = min(n, (low + 1) * step)
            block = [stored[high]]
            for j in range(high - 1, low * step - 1, -1):
                block.append(before(codes[j], block[-1]))
            block.reverse()
        if i < n:
            costs, behind = block[i - low * step], block[i - low * step + 1]
            if costs[state] == DELETE + behind[state]:
                i += 1
                yield "D", i - 1, state
                continue
        else:
            costs = after
        to = DUE[state]
        if costs[state] == INSERT + costs[to]:
            state = to
            yield "I", None, state
            continue
        edit = KEEP[codes[i]][state]
        letter = "K"
        if edit is None or costs[state] != edit[1] + behind[edit[0]]:
            edit, letter = RENAME[codes[i]][state], "R"
        state = edit[0]
        i += 1
        yield letter, i - 1, state
