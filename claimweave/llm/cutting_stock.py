"""Which lengths to put together: the cutting-stock linear program over a histogram of lengths, by column generation.

All of this works on the histogram alone (``units`` classes at most), so its cost does not depend on the number of documents.
"""

from __future__ import annotations

import numpy as np

#: Simplex steps at most. Any basis is a right packing, so stopping early costs a little padding only.
MOST_STEPS = 4_000


def priciest(prices: np.ndarray, sizes: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """The pattern of the largest total price whose sizes sum to ``units`` at most: an unbounded knapsack, by dynamic programming."""
    best, last = np.zeros(units + 1), np.full(units + 1, -1)
    for room in range(1, units + 1):
        fits = np.flatnonzero(sizes <= room)
        if len(fits):
            worth = best[room - sizes[fits]] + prices[fits]
            pick = int(np.argmax(worth))
            if worth[pick] > best[room - 1] + 1e-12:
                best[room], last[room] = worth[pick], fits[pick]
                continue
        best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes), dtype=np.int64), units
    while room > 0:
        if last[room] < 0 or best[room] == best[room - 1]:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(best[units]), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns over ``sizes``) and how often each is used, a solution of the linear program.

    Starts from one pattern per size; each step prices a new column by the knapsack and lets it replace the column
    that runs out first, until no column has a price above one bin.
    """
    basis = np.diag(units // sizes).astype(np.float64)
    used = demand / np.diag(basis)
    for _ in range(MOST_STEPS):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, pattern = priciest(prices, sizes, units)
        if worth <= 1 + 1e-9:
            break
        change = np.linalg.solve(basis, pattern.astype(np.float64))
        up = np.flatnonzero(change > 1e-9)
        steps = used[up] / change[up]
        out = up[int(np.argmin(steps))]
        step = max(steps.min(), 0.0)
        used = np.maximum(used - step * change, 0)
        basis[:, out], used[out] = pattern, step
    return np.rint(basis).astype(np.int64), used


def bins(counts: dict[int, int], units: int) -> list[tuple[dict[int, int], int]]:
    """``(pattern, times)`` for exactly the given counts of sizes: rounded-down columns, then first fit for the rest."""
    sizes = np.array(sorted(s for s, n in counts.items() if n), dtype=np.int64)
    if not len(sizes):
        return []
    demand = np.array([counts[int(s)] for s in sizes], dtype=np.int64)
    patterns, used = solve(sizes, demand.astype(np.float64), units)
    left, out = demand.copy(), []
    for column, times in zip(patterns.T, np.floor(used + 1e-6).astype(np.int64)):
        held = np.flatnonzero(column)
        times = int(min([times, *(left[held] // column[held])]))  # rounding must not ask for more than there is
        if times > 0:
            left -= times * column
            out.append(({int(sizes[i]): int(column[i]) for i in held}, times))
    while left.any():  # a largest-first pattern of what is left, as often as it fits
        room, pattern = units, {}
        for i in np.flatnonzero(left)[::-1]:
            n = int(min(left[i], room // sizes[i]))
            if n:
                pattern[i] = n
                room -= n * int(sizes[i])
        times = int(min(left[i] // n for i, n in pattern.items()))
        for i, n in pattern.items():
            left[i] -= times * n
        out.append(({int(sizes[i]): n for i, n in pattern.items()}, times))
    return out


def plan(counts: dict[int, int], units: int, keep: int) -> list[tuple[int, int, int, int, int]]:
    """``(size, low, high, each, first)``: ranks ``low`` to ``high - 1`` of a size go to bins from ``first``, ``each`` to a bin.

    ``keep`` bins are planned, those that waste least; ranks in no row belong to the rest.
    """
    found = sorted(bins(counts, units), key=lambda p: (units - sum(s * n for s, n in p[0].items()), sorted(p[0].items())))
    taken, rows, first = dict.fromkeys(counts, 0), [], 0
    for pattern, times in found:
        times = min(times, keep - first)
        if times <= 0:
            break
        for size, each in sorted(pattern.items(), reverse=True):
            rows.append((size, taken[size], taken[size] + each * times, each, first))
            taken[size] += each * times
        first += times
    return rows
