"""The data-quality gate for staged writes.

``claim_facts`` joins every proposed claim with the current versions of its key once;
each check is then a filter over those facts.  All staged writes of a batch are checked
against the same snapshot.  Recency caps are optional (``recent``); the default looks at
everything.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.functions.scores import clamp, exact, scaled_score, windows_overlap
from claimweave.functions.text import canonical_text, claim_key, distinct_nonempty, normalize_predicate, strip
from claimweave.operators import reads as R
from claimweave.operators.policy import Policy
from claimweave.plans.session import materialise, sized_broadcast

# Wording that marks speculative, bounded or confirmed statements.
CONFIRMED = r"\b(confirmed|already|currently|right now|now)\b"
SPECULATIVE = r"\b(would|could|might|hypothetical|counterfactual|what if|temporary|planning|plan|scenario|draft)\b"
BOUNDED = r"\b(during|itinerary|trip|conference|conference week|travel|visit|vacation|relocation|remote work)\b"

# Fixed values: (severity, reason code, message) per failing check.
OUTCOMES = {
    "low_trust_source_check": ("fail", "low_trust_source", "Source trust is below the quarantine threshold for a durable memory write."),
    "protected_predicate_review_check": ("warn", "protected_predicate_requires_review", "Protected predicates require review before automatic durable truth updates."),
    "contradiction_spike_check": ("fail", "contradicts_stronger_active_memory", "Proposed claim conflicts with stronger active memory without enough support."),
    "temporal_overlap_check": ("fail", "unsafe_temporal_overlap", "Proposed active windows overlap an existing value without a clear supersession time."),
    "branch_leakage_risk_check": ("fail", "branch_only_claim_on_main", "Future, temporary, or hypothetical memory should be written on a branch instead of main."),
    "rollback_regression_check": ("fail", "rollback_regression", "Proposed write reintroduces content or provenance that was previously rolled back."),
    "suspicious_same_object_corroboration_check": ("warn", "suspicious_corroboration_spike", "Same-object corroboration has an unusually high trust jump and should be reviewed."),
    "merge_conflict_policy_check": ("fail", "unsafe_merge_auto_resolution", "Merge-like write would auto-resolve a conflict that should stay reviewable."),
    "duplicate_source_anomaly_check": ("warn", "duplicate_source_anomaly", "Proposed write repeats an existing source/excerpt and may inflate support."),
    "support_gap_check": ("warn", "support_gap_for_protected_claim", "Protected claim lacks enough corroborating support for automatic application."),
}
BORDERLINE = ("warn", "borderline_trust_source", "Source trust is low enough to require review before becoming active truth.")
NO_CLAIMS = ("non_empty_claims_check", "fail", "no_claims", "No atomic claims were available for the proposed memory write.")
FAILURE_COLUMNS = ["staged_id", "check_name", "severity", "reason_code", "message"]
DECISION = ["staged_id", "decision", "overall_status", "score", "reason_summary"]


class Snapshot:
    """Ledger state the batch is checked against.

    current: viewer_id, claim_key, version_id, normalized_object, valid_from, valid_to, score_units, active_support_count.
    Versions and links, which one check in ten reads, may be functions that give them; they are called on first use.
    """

    def __init__(self, current: DataFrame, versions: DataFrame | Callable[[], DataFrame], links: DataFrame | Callable[[], DataFrame], sources: DataFrame):
        self.current, self._versions, self._links, self.sources = current, versions, links, sources

    @cached_property
    def versions(self) -> DataFrame:
        return self._versions() if callable(self._versions) else self._versions

    @cached_property
    def links(self) -> DataFrame:
        return self._links() if callable(self._links) else self._links


@dataclass
class CheckInput:
    staged: DataFrame
    facts: DataFrame
    snapshot: Snapshot
    policy: Policy
    today: str
    recent: int | None = None
    earlier: DataFrame | None = None
    """(staged_id, excerpt) of writes that count as sources for all writes after them"""


def staged_claims(staged: DataFrame, write: Sequence[Column] = ()) -> DataFrame:
    """One normalised row per proposed claim; writes without claims keep one empty row (claim_no null).

    ``error`` says what a claim lacks (subject, predicate or object); negation, quote and notes are carried where the
    proposals have them, and what ``write`` names of the write itself.
    """
    carried = [n for n in ("is_negation", "source_quote", "notes") if n in staged.schema["claims"].dataType.elementType.names]
    part = {n: F.coalesce(F.trim(F.col(f"claim.{n}")), F.lit("")) == "" for n in ("subject", "predicate", "object_value")}
    head = staged.select("staged_id", "claims", *write)
    told = [n for n in head.columns if n not in ("staged_id", "claims")]
    c = head.select("staged_id", F.posexplode_outer("claims").alias("claim_no", "claim"), *told)
    has = F.col("claim").isNotNull()
    return c.select(
        "staged_id", "claim_no",
        F.when(has, claim_key(F.col("claim.subject"), F.col("claim.predicate"))).alias("claim_key"),
        strip(F.col("claim.subject")).alias("subject"), normalize_predicate(F.col("claim.predicate")).alias("predicate"),
        strip(F.col("claim.object_value")).alias("object_value"), canonical_text(F.col("claim.object_value")).alias("normalized_object"),
        F.when(has, clamp(F.coalesce(F.col("claim.confidence"), F.lit("0.7").cast("decimal(6,4)")))).cast("decimal(6,4)").alias("confidence"),
        F.col("claim.valid_from").alias("valid_from"), F.col("claim.valid_to").alias("valid_to"), *[F.col(f"claim.{n}").alias(n) for n in carried],
        F.when(has & part["subject"], "subject missing").when(has & part["predicate"], "predicate missing").when(has & part["object_value"], "object missing").alias("error"), *told)


def branch_only_wording(text: Column, speculative: str = SPECULATIVE) -> tuple[Column, Column]:
    """(speculative or bounded wording, confirming wording)."""
    low = F.lower(text)
    return low.rlike(speculative) | low.rlike(BOUNDED), low.rlike(CONFIRMED)


def proposed_claims(staged: DataFrame, policy: Policy) -> DataFrame:
    """The valid claims of staged writes with their write's branch and trust and their policy class."""
    write = [F.col("branch_id"), (F.col("branch_name") == "main").alias("on_main"), clamp(F.col("trust_score")).cast("decimal(6,4)").alias("trust")]
    claims = staged_claims(staged, write).where("claim_no IS NOT NULL AND error IS NULL")
    return claims.withColumn("policy_class", policy.class_of(F.col("predicate")))


def claim_facts(staged: DataFrame, snapshot: Snapshot, policy: Policy) -> DataFrame:
    """Per proposed claim: its policy class and how it stands to what its branch currently holds.

    Where a branch holds one version of a key, a claim's facts are those of one pair, and only the join shuffles claims; pairs
    are aggregated for keys with several.
    """
    key = ["branch_id", "claim_key"]
    v = snapshot.current.select(
        F.col("viewer_id").alias("branch_id"), "claim_key", F.col("normalized_object").alias("v_object"),
        F.col("valid_from").alias("v_from"), F.col("valid_to").alias("v_to"), "score_units", "active_support_count")
    claims = proposed_claims(staged, policy)
    several = v.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    if several.isEmpty():
        return compared(claims.join(v, key, "left"), policy, single=True)
    several = sized_broadcast(several)
    one = compared(claims.join(several, key, "left_anti").join(v.join(several, key, "left_anti"), key, "left"), policy, single=True)
    return one.unionByName(compared(claims.join(several, key, "left_semi").join(v, key), policy))


def compared(pairs: DataFrame, policy: Policy, *, single: bool = False) -> DataFrame:
    """Facts per claim from proposed claims beside the versions they meet (``v_object``, ...; null where there is none).

    With ``single`` every claim is in one pair at most, so nothing is grouped.
    """
    present = F.col("v_object").isNotNull()
    dated = F.col("valid_from").isNotNull()
    # columns of their own, so that each is worked out once per pair
    pairs = pairs.withColumns({
        "same": present & (F.col("v_object") == F.col("normalized_object")),
        "differs": present & (F.col("v_object") != F.col("normalized_object")),
        "near": windows_overlap(F.col("v_from"), F.col("v_to"), F.col("valid_from"), F.col("valid_to")),
        "newer": dated & (F.col("v_from").isNull() | (F.col("valid_from") > F.col("v_from"))),
        "newer_or_same": dated & (F.col("v_from").isNull() | (F.col("valid_from") >= F.col("v_from")))})
    same, near = F.col("same"), F.col("near")
    other = F.col("differs") & near

    def n(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0).cast("long") if single else F.count(F.when(condition, 1))

    # behind a lambda: worked out for the pairs that come to it only, and not part of one method with all the rest
    scored = F.array("score_units")
    stronger = F.exists(scored, lambda units: scaled_score(exact(F.col("trust")), exact(F.col("confidence"))) < units)
    weak = F.exists(scored, lambda units: units < exact(policy.value(F.col("policy_class"), "jump_support_below")))
    backing = F.when(same, F.col("active_support_count"))
    told = ["claim_key", "subject", "predicate", "object_value", "normalized_object", "confidence", "valid_from", "valid_to", "on_main", "trust", "policy_class"]
    # a claim's own columns are grouped by as well: they are the same in all its pairs, and texts as values would have to be sorted
    facts = [
        n(same & near).alias("same_near"), n(other).alias("other_near"),
        n(other & ~F.col("newer_or_same") & stronger).alias("stronger_near"),
        n(other & ~F.col("newer")).alias("unordered_near"), n(same & weak).alias("weak_same"),
        F.coalesce(backing if single else F.sum(backing), F.lit(0)).cast("long").alias("same_support")]
    return pairs.select("staged_id", "claim_no", *told, *facts) if single else pairs.groupBy("staged_id", "claim_no", *told).agg(*facts)


# -- the checks: each returns the failing staged ids -----------------------------------

def _failing(rows: DataFrame, name: str, outcome=None) -> DataFrame:
    severity, code, message = outcome or OUTCOMES[name]
    return rows.select(
        "staged_id", F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), F.lit(code).alias("reason_code"),
        F.lit(message).alias("message"))


#: Checks by name: functions from ``CheckInput`` to failing rows (``FAILURE_COLUMNS``), in which a row may come more than once.
REGISTRY: dict[str, Callable[[CheckInput], DataFrame]] = {}


def _check(name: str):
    """Register a check; called by its own name it gives each failing write once."""
    def wrap(find: Callable[[CheckInput], DataFrame]):
        REGISTRY[name] = find

        @functools.wraps(find)
        def check(x: CheckInput) -> DataFrame:
            return find(x).distinct()
        return check
    return wrap


@_check("low_trust_source_check")
def check_low_trust(x: CheckInput) -> DataFrame:
    limits = x.facts.groupBy("staged_id").agg(
        F.max(x.policy.value(F.col("policy_class"), "fail_below")).alias("f"),
        F.max(x.policy.value(F.col("policy_class"), "warn_below")).alias("w"))
    default = x.policy.by_name[x.policy.default]
    rows = x.staged.select("staged_id", clamp(F.col("trust_score")).cast("decimal(6,4)").alias("trust")).join(limits, "staged_id", "left")
    f = F.coalesce("f", F.lit(str(default.fail_below)).cast("decimal(6,4)"))
    w = F.coalesce("w", F.lit(str(default.warn_below)).cast("decimal(6,4)"))
    name = "low_trust_source_check"
    return _failing(rows.where(F.col("trust") < f), name).unionByName(
        _failing(rows.where((F.col("trust") >= f) & (F.col("trust") < w)), name, BORDERLINE))


@_check("protected_predicate_review_check")
def check_protected(x: CheckInput) -> DataFrame:
    return _failing(x.facts.where(F.col("on_main") & x.policy.value(F.col("policy_class"), "review_on_main")), "protected_predicate_review_check")


@_check("contradiction_spike_check")
def check_contradiction(x: CheckInput) -> DataFrame:
    return _failing(x.facts.where("on_main AND same_near = 0 AND stronger_near > 0"), "contradiction_spike_check")


@_check("temporal_overlap_check")
def check_temporal(x: CheckInput) -> DataFrame:
    return _failing(x.facts.where("unordered_near > 0"), "temporal_overlap_check")


@_check("branch_leakage_risk_check")
def check_branch_leak(x: CheckInput) -> DataFrame:
    tentative, confirmed = branch_only_wording(F.col("excerpt"))
    future = x.facts.groupBy("staged_id").agg(F.bool_or(F.col("valid_from") > F.to_date(F.lit(x.today))).alias("future"))
    rows = x.staged.where("branch_name = 'main'").join(future, "staged_id", "left")
    return _failing(rows.where(~confirmed & (tentative | F.coalesce("future", F.lit(False)))), "branch_leakage_risk_check")


@_check("rollback_regression_check")
def check_rollback_regression(x: CheckInput) -> DataFrame:
    versions, links = x.snapshot.versions, x.snapshot.links
    if x.recent is not None:
        versions = versions.where("status = 'retracted'").orderBy(F.col("version_id").desc()).limit(x.recent)
        links = links.where("status = 'rolled_back'").orderBy(F.col("link_pos").desc()).limit(x.recent)
    found = R.rolled_back_match(x.facts, versions, links, x.snapshot.sources, x.staged)
    return _failing(found, "rollback_regression_check")


@_check("suspicious_same_object_corroboration_check")
def check_suspicious_support(x: CheckInput) -> DataFrame:
    jump = F.col("trust") >= x.policy.value(F.col("policy_class"), "jump_trust")
    return _failing(x.facts.where(jump & (F.col("weak_same") > 0)), "suspicious_same_object_corroboration_check")


@_check("merge_conflict_policy_check")
def check_merge_text(x: CheckInput) -> DataFrame:
    says = F.contains(F.lower(F.concat_ws(" ", "excerpt", "message")), F.lit("merge"))
    clash = x.facts.where("other_near > 0").select("staged_id").distinct()
    return _failing(x.staged.where(says).select("staged_id").join(clash, "staged_id", "left_semi"), "merge_conflict_policy_check")


@_check("duplicate_source_anomaly_check")
def check_duplicate_source(x: CheckInput) -> DataFrame:
    sources = x.snapshot.sources
    if x.recent is not None:
        sources = sources.orderBy(F.col("source_id").desc()).limit(x.recent)
    # written without repeats: a few texts are sent to all workers, and the writes are not shuffled by text
    known = materialise(sources.select("excerpt").distinct().select(canonical_text(F.col("excerpt")).alias("k")).where("k <> ''").distinct(), "known-texts")
    keyed = x.staged.select("staged_id", canonical_text(F.col("excerpt")).alias("k"))
    rows = keyed.join(known, "k", "left_semi")
    if x.earlier is not None:
        first = x.earlier.groupBy(canonical_text(F.col("excerpt")).alias("k")).agg(F.min("staged_id").alias("first")).where("k <> ''")
        rows = rows.unionByName(keyed.join(first, "k").where("first < staged_id").select("k", "staged_id"))
    return _failing(rows, "duplicate_source_anomaly_check")


@_check("support_gap_check")
def check_support_gap(x: CheckInput) -> DataFrame:
    need = x.policy.value(F.col("policy_class"), "support_needed")
    sensitive = (need > 1) | x.policy.value(F.col("policy_class"), "review_on_main")
    short = (F.col("trust") < x.policy.value(F.col("policy_class"), "auto_apply_trust")) & (F.col("same_support") + 1 < need)
    return _failing(x.facts.where(F.col("on_main") & sensitive & short), "support_gap_check")


#: The gate's own checks, and all outcomes they have.
OWN_CHECKS = dict(REGISTRY)
KNOWN = (*((name, *outcome) for name, outcome in OUTCOMES.items()), ("low_trust_source_check", *BORDERLINE), NO_CLAIMS)
OUTCOME = "array<struct<check_name:string,severity:string,reason_code:string,message:string>>"


def register_check(name: str, check: Callable[[CheckInput], DataFrame]) -> None:
    """Add a check: a function from ``CheckInput`` to failing rows (``FAILURE_COLUMNS``); equal rows count once."""
    REGISTRY[name] = check


def check_input(staged: DataFrame, snapshot: Snapshot, *, today: str, policy: Policy | None = None,
                recent: int | None = None) -> CheckInput:
    """Writes still open (neither applied nor rejected) with their facts."""
    policy = policy or Policy()
    staged = staged.where(~F.col("status").isin("applied", "rejected"))
    return CheckInput(staged, claim_facts(staged, snapshot, policy), snapshot, policy, today, recent)


def _bits(name: str) -> list[tuple[int, tuple[str, str, str, str]]]:
    return [(i, known) for i, known in enumerate(KNOWN) if known[0] == name]


def _outcome(values: Sequence[Column]) -> Column:
    return F.struct(*[v.alias(c) for c, v in zip(FAILURE_COLUMNS[1:], values)])


def _failures(x: CheckInput) -> DataFrame:
    """(staged_id, mask, added): writes that fail a check, with a bit for each of the gate's own outcomes and those of added checks.

    The gate's own outcomes are a fixed list, so only a bit for each is shuffled; outcomes of added checks are gathered as they are.
    """
    bits, other = [x.staged.where(F.coalesce(F.size("claims"), F.lit(0)) <= 0).select("staged_id", F.lit(1 << KNOWN.index(NO_CLAIMS)).cast("long").alias("bit"))], []
    for name in x.policy.checks:
        if REGISTRY[name] is OWN_CHECKS.get(name):
            rows = OWN_CHECKS[name](x)
            told = F.coalesce(*[F.when(F.col("reason_code") == known[2], F.lit(1 << i).cast("long")) for i, known in _bits(name)])
            bits.append(rows.select("staged_id", told.alias("bit")))
        else:
            other.append(REGISTRY[name](x).select(*FAILURE_COLUMNS))
    mask = functools.reduce(DataFrame.unionByName, bits).groupBy("staged_id").agg(F.bit_or("bit").alias("mask"))
    if not other:
        return mask.withColumn("added", F.lit(None).cast(OUTCOME))
    added = functools.reduce(DataFrame.unionByName, other).groupBy("staged_id").agg(F.collect_set(_outcome([F.col(c) for c in FAILURE_COLUMNS[1:]])).alias("added"))
    return mask.join(added, "staged_id", "full")


def _with_failures(staged: DataFrame, failures: DataFrame) -> DataFrame:
    """(writes' columns, ``failed``): every write once, with the outcomes of the checks it fails (``FAILURE_COLUMNS`` but the id)."""
    own = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i).cast("long")) != 0, _outcome([F.lit(v) for v in known])) for i, known in enumerate(KNOWN)]))
    failed = F.concat(own, F.coalesce("added", F.expr(f"cast(array() as {OUTCOME})")))
    return staged.join(failures, "staged_id", "left").withColumn("failed", failed).drop("mask", "added")


def failed_checks(x: CheckInput) -> DataFrame:
    """Every write once with its ``failed`` outcomes."""
    return _with_failures(x.staged, _failures(x))


def _passed(failed: Column, checks: Sequence[str]) -> Column:
    """Names of the checks that a write does not fail."""
    return F.array_except(F.array(*[F.lit(n) for n in checks]).cast("array<string>"), F.transform(failed, lambda f: f["check_name"]))


def _report(rows: DataFrame, checks: Sequence[str]) -> DataFrame:
    """One row per write (with ``failed``) and check, and whether it is passed."""
    passed = F.transform(_passed(F.col("failed"), checks), lambda n: F.struct(
        n.alias("check_name"), F.lit("info").alias("severity"), F.lit("passed").alias("reason_code"), F.lit("Check passed.").alias("message")))
    return rows.select("staged_id", F.inline(F.concat("failed", passed))).withColumn("passed", F.col("severity") == "info")


def check_results(x: CheckInput) -> DataFrame:
    """One row per staged write and enabled check."""
    return _report(failed_checks(x), x.policy.checks)


def decided(rows: DataFrame, checks: Sequence[str], *, messages: int | None = None) -> DataFrame:
    """``ci_decision`` of writes that carry their ``failed`` outcomes: a matter of each row, nothing is shuffled.

    A reader of the decision alone does not sort or word the failures.
    """
    passed = F.size(_passed(F.col("failed"), checks))
    told = F.filter("failed", lambda f: f["severity"] != "info")
    place = _places(checks)

    def of_kind(severity: str) -> Column:
        return F.filter("failed", lambda f: f["severity"] == severity)

    def entries(severity: str) -> Column:
        return F.array_sort(F.transform(of_kind(severity), lambda f: F.struct(place(f["check_name"]).alias("place"), f["message"].alias("message"), f["reason_code"].alias("reason_code"))))

    sums = rows.withColumns({
        "n_checks": F.size("failed") + passed, "n_passed": passed + F.size("failed") - F.size(told), "fails": entries("fail"), "warns": entries("warn"),
        "empty": F.exists("failed", lambda f: f["reason_code"] == "no_claims")})
    counted = sums.withColumns({"n_fail": F.size(of_kind("fail")), "n_warn": F.size(of_kind("warn"))}).withColumn("decision", _decision())
    if not checks:  # with any check, a write passes or fails it
        counted = counted.where("n_checks > 0")
    return counted.select(*rows.columns, "decision", *_told(messages))


def _places(checks: Sequence[str]) -> Callable[[Column], Column]:
    order = F.array(*[F.lit(n) for n in (*checks, NO_CLAIMS[0])])
    return lambda name: F.array_position(order, name)


def ci_decision(staged: DataFrame, results: DataFrame, check_order: tuple[str, ...] | None = None, *, messages: int | None = None) -> DataFrame:
    """Decision per staged write from its check rows: reject, quarantine, require_review or auto_apply.

    The summary has the first ``messages`` messages, all if not given.
    """
    place = _places(check_order or Policy().checks)(F.col("check_name"))
    entry = F.struct(place.alias("place"), "message", "reason_code")
    sums = results.groupBy("staged_id").agg(
        F.count("*").alias("n_checks"), F.count(F.when(F.col("passed"), 1)).alias("n_passed"),
        F.count(F.when(~F.col("passed") & (F.col("severity") == "fail"), 1)).alias("n_fail"),
        F.count(F.when(~F.col("passed") & (F.col("severity") == "warn"), 1)).alias("n_warn"),
        F.coalesce(F.bool_or(F.col("reason_code") == "no_claims"), F.lit(False)).alias("empty"),
        F.array_sort(F.collect_list(F.when(~F.col("passed") & (F.col("severity") == "fail"), entry))).alias("fails"),
        F.array_sort(F.collect_list(F.when(~F.col("passed") & (F.col("severity") == "warn"), entry))).alias("warns"))
    rows = staged.select("staged_id", "review_required", "risk_reasons").join(sums, "staged_id")
    return rows.withColumn("decision", _decision()).select("staged_id", "decision", *_told(messages)).withColumnRenamed("problems", "failed")


def _decision() -> Column:
    return (
        F.when(F.col("empty"), "reject").when(F.col("n_fail") > 0, "quarantine")
        .when((F.col("n_warn") > 0) | F.col("review_required"), "require_review").otherwise("auto_apply"))


def _told(messages: int | None) -> list[Column]:
    """What goes with a ``decision``: status, score, summary, and the failures in order (``problems``)."""
    fail_text = F.transform("fails", lambda e: e["message"])
    warn_text = F.transform("warns", lambda e: e["message"])
    own = F.when(F.col("review_required"), F.coalesce("risk_reasons", F.expr("cast(array() as array<string>)"))).otherwise(
        F.expr("cast(array() as array<string>)"))

    def summary(texts: Column) -> Column:
        told = distinct_nonempty(texts)
        return F.array_join(told if messages is None else F.slice(told, 1, messages), "; ")

    warn_summary = summary(F.concat(warn_text, own))
    return [
        F.when(F.col("decision").isin("reject", "quarantine"), "fail").when(F.col("decision") == "require_review", "warn")
        .otherwise("pass").alias("overall_status"),
        F.round(F.col("n_passed") / F.greatest(F.col("n_checks"), F.lit(1)), 4).alias("score"),
        F.when(F.col("decision") == "reject", F.lit(NO_CLAIMS[3])).when(F.col("decision") == "quarantine", summary(fail_text))
        .when(F.col("decision") == "require_review", F.when(warn_summary == "", "Policy requires review.").otherwise(warn_summary))
        .alias("reason_summary"),
        F.array_sort(F.concat("fails", "warns")).alias("problems")]


def run_checks(x: CheckInput, *, messages: int | None = None, written: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(updated staged writes, decisions, check rows); ``messages`` as in ``ci_decision``.

    All three join the writes (``written``: they are a written table already) with one written table that has a mask of failures per
    write, so a reader shuffles the columns of the writes that it asks for only.
    """
    from dataclasses import replace
    # ten checks read the writes and the facts: both are written once, so texts are parsed and matched once
    x = replace(x, staged=x.staged if written else materialise(x.staged, "open-writes"), facts=materialise(x.facts, "claim-facts"))
    rows = decided(_with_failures(x.staged, materialise(_failures(x), "checked-writes")), x.policy.checks, messages=messages)
    status = (
        F.when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "quarantine", "quarantined")
        .when(F.col("decision") == "require_review", "review_required").otherwise("checked"))
    none = F.expr("cast(array() as array<string>)")
    merged = rows.select(
        *[c for c in x.staged.columns if c not in ("status", "review_required", "risk_reasons", "warnings")],
        status.alias("status"),
        F.when(F.col("decision") == "reject", False).when(F.col("decision").isin("quarantine", "require_review"), True)
        .otherwise(F.col("review_required")).alias("review_required"),
        distinct_nonempty(F.concat(F.coalesce("risk_reasons", none), F.transform("problems", lambda e: e["reason_code"]))).alias("risk_reasons"),
        distinct_nonempty(F.concat(F.coalesce("warnings", none), F.transform("problems", lambda e: e["message"]))).alias("warnings"),
        F.when(F.col("decision") == "quarantine", F.col("reason_summary")).alias("quarantine_reason"),
        F.when(F.col("decision") == "quarantine", "blocked").alias("quarantine_release"))
    return merged, rows.select(*DECISION), _report(rows, x.policy.checks)


def check_report(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Rows of the latest run of each staged write (runs: run_id, staged_id; results: run_id, ...)."""
    latest = runs.groupBy("staged_id").agg(F.max("run_id").alias("run_id"))
    return results.join(latest, "run_id")
