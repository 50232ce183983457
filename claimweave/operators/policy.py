"""Predicate policy classes as data: rules pick a class, classes carry thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class PolicyClass:
    name: str
    review_on_main: bool = False
    fail_below: float = 0.35
    warn_below: float = 0.65
    auto_apply_trust: float = 0.75
    support_needed: int = 1
    jump_trust: float = 0.97
    jump_support_below: float = 0.65


# Thresholds of the default policy classes.
DEFAULT_CLASSES = (
    PolicyClass("low_risk"),
    PolicyClass("identity_state", review_on_main=True, auto_apply_trust=0.9),
    PolicyClass("financial", review_on_main=True, fail_below=0.45, warn_below=0.75, auto_apply_trust=0.95, support_needed=2),
    PolicyClass("operational_deadline", review_on_main=True, fail_below=0.4, warn_below=0.7, auto_apply_trust=0.92),
)
# Fixed values: (class, exact predicates, pattern), first match wins.
DEFAULT_RULES = (
    ("identity_state", ("lives_in", "works_at", "owns"),
     "residence|resident|address|location|located|workplace|employer|employment|owner|owns"),
    ("financial", ("salary", "compensation", "bank_account", "payment_method"),
     "salary|compensation|bank|payment|invoice|budget|revenue"),
    ("operational_deadline", ("due_date", "launch_date", "cancellation_state"), "due|deadline|launch|cancel|cancellation"),
)
# The checks of the default suite, in report order.
DEFAULT_CHECKS = (
    "low_trust_source_check", "protected_predicate_review_check", "contradiction_spike_check", "temporal_overlap_check",
    "branch_leakage_risk_check", "rollback_regression_check", "suspicious_same_object_corroboration_check",
    "merge_conflict_policy_check", "duplicate_source_anomaly_check", "support_gap_check",
)


@dataclass(frozen=True)
class Policy:
    classes: tuple[PolicyClass, ...] = DEFAULT_CLASSES
    rules: tuple[tuple[str, tuple[str, ...], str], ...] = DEFAULT_RULES
    checks: tuple[str, ...] = DEFAULT_CHECKS
    default: str = "low_risk"
    suite: str = "claim-checks-v1"
    by_name: dict = field(init=False, repr=False, compare=False, default=None)

    def __post_init__(self):
        object.__setattr__(self, "by_name", {c.name: c for c in self.classes})

    def class_of(self, predicate: Column) -> Column:
        """Class name of a normalised predicate."""
        out = None
        for name, exact_names, pattern in self.rules:
            hit = predicate.isin(*exact_names) | predicate.rlike(pattern)
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise(self.default) if out is not None else F.lit(self.default)

    def value(self, class_name: Column, attribute: str) -> Column:
        """A class attribute looked up by class name."""
        pairs = []
        for c in self.classes:
            v = getattr(c, attribute)
            lit = F.lit(str(v)).cast("decimal(6,4)") if isinstance(v, float) else F.lit(v)
            pairs += [F.lit(c.name), lit]
        return F.element_at(F.create_map(*pairs), class_name)
