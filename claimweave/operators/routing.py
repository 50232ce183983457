"""Routing of proposed writes: which branch, how much trust, review or not."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.functions.scores import clamp
from claimweave.functions.text import distinct_nonempty, safe_branch_name
from claimweave.operators.checks import branch_only_wording

# Routing thresholds and wording.
LOW_TRUST, LOW_CONFIDENCE, IMPLAUSIBLE_CAP = "0.5", "0.5", "0.25"
SPECULATIVE = r"\b(would|could|might|hypothetical|counterfactual|what if|temporary|planning|plan|scenario)\b"
BRANCH_WORDS = r"\b(branch|workspace|scenario|hypothetical|what-if|what if|trip-plan|conference-week|relocation)\b"
FICTION = r"\b(fiction|fictional|story|novel|game|roleplay|role-play|fantasy|worldbuilding|imaginary)\b"
PLACE_PREDICATE = r"(live|lives|resid|stay|stays|location|located|address|city|country|move|moved|base|work_from|visit)"
FICTIONAL_PLACES = ("atlantis", "narnia", "hogwarts", "mordor", "middle earth", "neverland", "wakanda", "gotham", "metropolis", "asgard")
RELOCATION = r"\b(?:in\s+)?(?:the\s+)?([a-z][a-z0-9-]{2,40})\s+relocation\s+scenario\b"
FELLOWSHIP = r"\b([a-z][a-z0-9-]{2,40})\s+fellowship\b"
SCENARIO = r"\b(?:in\s+)?(?:the\s+)?([a-z][a-z0-9-]{2,40}(?:\s+[a-z][a-z0-9-]{2,40}){0,2})\s+scenario\b"
# Names given by words in the text, in this order.
NAMES_BY_WORDS = (
    (("fellowship", "kyoto"), "kyoto-fellowship"),
    (("fellowship",), "fellowship-plan"),
    (("relocation",), "relocation-scenario"),
    (("remote work",), "remote-work-plan"),
    (("conference",), "conference-week"),
    (("trip",), "trip-plan"),
    (("itinerary",), "trip-plan"),
    (("travel",), "trip-plan"),
    (("what if",), "hypothetical"),
    (("hypothetical",), "hypothetical"),
    (("counterfactual",), "hypothetical"),
)
OTHER_NAME = "branch-hypothesis"


def branch_only_flag(excerpt: Column, any_valid_to: Column, any_future: Column) -> Column:
    """Speculative, bounded or future content; ending windows count, the word "draft" does not."""
    tentative, confirmed = branch_only_wording(excerpt, SPECULATIVE)
    return ~confirmed & (tentative | any_valid_to | any_future)


def derive_branch_name(excerpt: Column) -> Column:
    """Branch name suggested by the wording, most specific pattern first."""
    low = F.lower(excerpt)

    def named(pattern: str, suffix: str) -> Column:
        found = F.regexp_extract(low, pattern, 1)
        return F.when(low.rlike(pattern), safe_branch_name(F.concat(found, F.lit(suffix))))

    by_words = [F.when(functools.reduce(operator.and_, [F.contains(low, F.lit(w)) for w in words]), F.lit(name)) for words, name in NAMES_BY_WORDS]
    return F.coalesce(named(RELOCATION, "-relocation"), named(FELLOWSHIP, "-fellowship"), named(SCENARIO, "-scenario"), *by_words, F.lit(OTHER_NAME))


def explicit_branch_reference(excerpt: Column) -> Column:
    return F.lower(excerpt).rlike(BRANCH_WORDS)


def mentions_branch(excerpt: Column, branch_name: Column) -> Column:
    """The text names this branch, dashed or spaced."""
    low = F.lower(excerpt)
    clean = safe_branch_name(branch_name)
    dashed = F.btrim(F.regexp_replace(F.replace(low, F.lit("_"), F.lit("-")), "[^a-z0-9-]+", "-"), F.lit("-"))
    return F.contains(dashed, clean) | F.contains(low, F.replace(clean, F.lit("-"), F.lit(" ")))


def implausible_place(predicate: Column, object_value: Column) -> Column:
    """A location-like claim about a fictional place."""
    label = F.replace(safe_branch_name(predicate), F.lit("-"), F.lit("_"))
    text = F.regexp_replace(F.lower(object_value), "[^a-z0-9 ]+", " ")
    return label.rlike(PLACE_PREDICATE) & text.rlike("|".join(FICTIONAL_PLACES))


def review_requirements(facts: DataFrame, writes: DataFrame, today: str) -> DataFrame:
    """(staged_id, review_required, review_reasons) for routed writes.

    ``facts`` are ``checks.claim_facts`` plus ``confidence``-level flags per claim.
    """
    low_conf = F.bool_or(F.col("confidence") < F.lit(LOW_CONFIDENCE).cast("decimal(6,4)"))
    clash = F.bool_or(F.expr("on_main AND same_near = 0 AND stronger_near > 0"))
    per = facts.groupBy("staged_id").agg(
        low_conf.alias("low_conf"), clash.alias("clash"),
        F.bool_or(F.col("valid_to").isNotNull()).alias("ends"),
        F.bool_or(F.col("valid_from") > F.to_date(F.lit(today))).alias("future"))
    no = F.lit(False)
    rows = writes.join(per, "staged_id", "left")
    leak = (F.col("branch_name") == "main") & branch_only_flag(F.col("excerpt"), F.coalesce("ends", no), F.coalesce("future", no))
    reasons = F.array_compact(F.array(
        F.when(clamp(F.col("trust_score")) < F.lit(LOW_TRUST).cast("decimal(6,4)"), "low_trust_source"),
        F.when(leak, "branch_only_claim_on_main"),
        F.when(F.coalesce("low_conf", no), "low_claim_confidence"),
        F.when(F.coalesce("clash", no), "conflicts_with_stronger_current_memory")))
    return rows.select("staged_id", reasons.alias("review_reasons")).withColumn("review_required", F.size("review_reasons") > 0)


def route_writes(plans: DataFrame, claims: DataFrame, today: str) -> DataFrame:
    """Branch, trust and action of each proposed write before review requirements are applied.

    plans: staged_id, branch_name, trust_score, write_action, excerpt, risk_reasons, warnings
    claims: staged_id, predicate, object_value, valid_from, valid_to
    """
    per = claims.groupBy("staged_id").agg(
        F.bool_or(implausible_place(F.col("predicate"), F.col("object_value"))).alias("odd_place"),
        F.bool_or(F.col("valid_to").isNotNull()).alias("ends"),
        F.bool_or(F.col("valid_from") > F.to_date(F.lit(today))).alias("future"))
    no = F.lit(False)
    x = plans.join(per, "staged_id", "left").select(
        "staged_id", "excerpt", "write_action", "risk_reasons",
        safe_branch_name(F.col("branch_name")).alias("asked"), clamp(F.col("trust_score")).cast("decimal(6,4)").alias("trust"),
        (F.coalesce("odd_place", no) & ~F.lower("excerpt").rlike(FICTION)).alias("odd"),
        branch_only_flag(F.col("excerpt"), F.coalesce("ends", no), F.coalesce("future", no)).alias("branch_only"),
        derive_branch_name(F.col("excerpt")).alias("derived"))
    cap = F.lit(IMPLAUSIBLE_CAP).cast("decimal(6,4)")
    x = x.withColumn("trust", F.when(F.col("odd"), F.least("trust", cap)).otherwise(F.col("trust")))
    rejected = F.col("write_action") == "reject"
    asked_hypothetical = (F.col("write_action") == "branch_hypothetical") & (F.col("asked") == "main") & ~rejected
    x = x.withColumn("start", F.when(asked_hypothetical, F.col("derived")).otherwise(F.col("asked")))
    # columns of their own, so that each wording is looked for once
    x = x.withColumns({
        "to_branch": (F.col("start") == "main") & F.col("branch_only"),
        "stale": (F.col("start") != "main") & F.col("branch_only") & (F.col("start") != F.col("derived")) & ~mentions_branch(F.col("excerpt"), F.col("start")),
        "home": (F.col("start") != "main") & ~F.col("branch_only") & ~explicit_branch_reference(F.col("excerpt"))})
    to_branch, stale, home = F.col("to_branch"), F.col("stale"), F.col("home")
    branch = (F.when(rejected, F.col("asked")).when(to_branch | stale, F.col("derived")).when(home, F.lit("main")).otherwise(F.col("start")))
    action = (
        F.when(rejected, "reject").when(to_branch, "branch_hypothetical")
        .when(stale & (F.col("write_action") == "commit_now"), "branch_hypothetical")
        .when(home & (F.col("write_action") == "branch_hypothetical"), "commit_now").otherwise(F.col("write_action")))
    extra = F.array_compact(F.array(
        F.when(F.col("odd"), "implausible_real_world_claim"), F.when(rejected, "model_write_action:reject"),
        F.when(~rejected & to_branch, "branch_only_claim")))
    none = F.expr("cast(array() as array<string>)")
    return x.select(
        "staged_id", branch.alias("branch_name"), F.col("trust").alias("trust_score"), action.alias("write_action"),
        distinct_nonempty(F.concat(F.coalesce("risk_reasons", none), extra)).alias("risk_reasons"), "excerpt")


def final_action(routed: DataFrame, review: DataFrame) -> DataFrame:
    """Join review requirements: a required review turns commit_now into stage_for_review."""
    r = routed.join(review, "staged_id", "left")
    live = F.col("write_action") != "reject"
    need = live & F.coalesce("review_required", F.lit(False))
    none = F.expr("cast(array() as array<string>)")
    return r.select(
        "staged_id", "branch_name", "trust_score",
        F.when(need & (F.col("write_action") == "commit_now"), "stage_for_review").otherwise(F.col("write_action")).alias("write_action"),
        need.alias("review_required"),
        F.when(live, distinct_nonempty(F.concat("risk_reasons", F.coalesce("review_reasons", none)))).otherwise(F.col("risk_reasons")).alias("risk_reasons"))
