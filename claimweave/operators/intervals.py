"""Joins of dates with windows and of windows with windows, without a product per key.

A window is cut into aligned blocks of days whose sizes are powers of ``RADIX``: at most a few per size, together exactly the
window. A date lies in one block of each size, so "the window holds the date" is equality of one block: an
ordinary join whose result has each pair once, and a maximum over all windows that hold a date needs no pairs at all, only
maxima per block. Two windows overlap if one holds the other's first day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RADIX, LEVELS = 8, 8
#: ``RADIX ** LEVELS`` days, half of them before 1970, cover all dates.
SPAN = RADIX ** LEVELS
_SHIFT = SPAN // 2


def first_day(start: Column) -> Column:
    """A window's first day as a number; null is unbounded."""
    return F.coalesce(F.unix_date(start).cast("long") + _SHIFT, F.lit(0).cast("long"))


def end_day(end: Column) -> Column:
    """The day after a window's last; null is unbounded."""
    return F.coalesce(F.unix_date(end).cast("long") + (_SHIFT + 1), F.lit(SPAN).cast("long"))


def blocks_of_window(low: Column, high: Column) -> Column:
    """``array<struct<level, block>>``: the fewest aligned blocks that make up days ``low`` to ``high - 1``."""
    parts = []
    none = F.expr("cast(array() as array<bigint>)")

    def steps(a: Column, b: Column) -> Column:
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(none)

    def tagged(found: Column, level: int) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(level).alias("level"), x.alias("block")))

    for level in range(LEVELS + 1):
        size = RADIX ** level
        a, b = F.ceil(low / size), F.floor(high / size)
        if level < LEVELS:
            # what larger blocks cover is theirs
            up_a, up_b = F.ceil(low / (size * RADIX)) * RADIX, F.floor(high / (size * RADIX)) * RADIX
            found = F.when(up_a < up_b, F.concat(steps(a, up_a), steps(up_b, b))).otherwise(steps(a, b))
        else:
            found = steps(a, b)
        parts.append(tagged(found, level))
    return F.when(low < high, F.flatten(F.array(*parts))).otherwise(F.expr("cast(array() as array<struct<level:int,block:bigint>>)"))


def blocks_of_day(day: Column) -> Column:
    """``array<struct<level, block>>``: the block of each size in which a day lies."""
    return F.array(*[F.struct(F.lit(n).alias("level"), F.floor(day / RADIX ** n).alias("block")) for n in range(LEVELS + 1)])


def holding(days: DataFrame, day: Column, windows: DataFrame, low: Column, high: Column, keys: list[str]) -> DataFrame:
    """Pairs of rows where the window holds the day, each once; all columns of both sides (named apart but for ``keys``)."""
    left = days.select("*", F.inline(blocks_of_day(day)))
    right = windows.select("*", F.inline(blocks_of_window(low, high)))
    return left.join(right, [*keys, "level", "block"]).drop("level", "block")


def best_holding(days: DataFrame, day: Column, windows: DataFrame, low: Column, high: Column, value: Column, keys: list[str]) -> DataFrame:
    """``days`` with ``best``: the largest ``value`` of the windows that hold the day; days that none holds are left out."""
    best = windows.select(*keys, F.inline(blocks_of_window(low, high)), value.alias("value")).groupBy(*keys, "level", "block").agg(F.max("value").alias("value"))
    names = days.columns
    return days.select("*", F.inline(blocks_of_day(day))).join(best, [*keys, "level", "block"]).groupBy(*names).agg(F.max("value").alias("best"))
