"""Trust and score arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNIT = 10_000


def exact(value: Column) -> Column:
    """A 0..1 score as an integer in units of 1e-4: sums of it do not depend on order."""
    return F.round(clamp(value).cast("decimal(18,8)") * UNIT, 0).cast("long")


def clamp(value: Column) -> Column:
    """Limit a score to [0, 1]."""
    zero, one = F.lit(0).cast("decimal(1,0)"), F.lit(1).cast("decimal(1,0)")
    return F.greatest(zero, F.least(one, value))


def as_score(units: Column) -> Column:
    """Units of 1e-4 back to a double."""
    return (units.cast("decimal(30,0)") / F.lit(UNIT).cast("decimal(6,0)")).cast("decimal(30,4)").cast("double")


def scaled_score(net: Column, confidence: Column) -> Column:
    """round(max(0, net) * confidence, 4), all in units of 1e-4, half up."""
    product = F.greatest(net, F.lit(0).cast("long")).cast("decimal(20,0)") * confidence.cast("decimal(6,0)")
    return F.round(product * F.lit("0.0001").cast("decimal(5,4)"), 0).cast("long")


def belief_score(confidence: Column, trust: Column) -> Column:
    """round(confidence * trust, 4)."""
    product = confidence.cast("decimal(8,6)") * trust.cast("decimal(8,6)")
    return F.round(product, 4).cast("double")


def windows_overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Closed date windows, a null bound being open."""
    before = F.coalesce(a_from <= b_to, F.lit(True))
    return before & F.coalesce(b_from <= a_to, F.lit(True))
