"""Staged writes from proposal to commit: allowed transitions as data, refusals as an error frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimweave.operators.checks import staged_claims
from claimweave.operators.increment import LedgerStore
from claimweave.plans.session import materialise

REVIEWABLE = ("pending", "proposed", "checked", "review_required", "approved")
TERMINAL = ("applied", "rejected")


def create_branches(requests: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(created, refused) from (seq, name, parent_name) requests.

    Requests count in order of ``seq``: one is valid if its parent (main by default) existed before or was created by an
    earlier request, and the first valid request of a name wins.  Creation times fall from round to round until
    they are those of that order; a round follows one level of the branch tree.
    """
    spark = requests.sparkSession
    known = spark.sql("SELECT 'main' AS name, CAST(NULL AS STRING) AS parent_name, CAST(NULL AS BIGINT) AS created_seq")
    if existing is not None:
        known = existing.select("name", "parent_name", "created_seq")
    old = known.select("name", F.lit(None).cast("string").alias("parent_name"), F.lit(-1).cast("long").alias("at"))
    asked = requests.select("seq", "name", F.coalesce("parent_name", F.when(F.col("name") != "main", F.lit("main"))).alias("parent_name"))
    asked = materialise(asked.join(known.select("name"), "name", "left_anti"), "branch-requests")
    made, before = asked.limit(0).select("name", "parent_name", F.col("seq").alias("at")), None
    while True:
        there = old.unionByName(made).select(F.col("name").alias("parent_name"), F.col("at").alias("parent_at"))
        valid = asked.join(there, "parent_name").where("parent_at < seq")
        made = materialise(valid.groupBy("name").agg(F.min(F.struct("seq", "parent_name")).alias("r")).select("name", "r.parent_name", F.col("r.seq").alias("at")), "branches-made")
        now = tuple(made.agg(F.count("*"), F.sum("at")).first())
        if now == before:
            break
        before = now
    good = made.select("name", "parent_name", F.col("at").alias("created_seq"))
    taken = requests.join(good.select("name", F.col("created_seq").alias("seq")), ["name", "seq"], "left_anti")
    return known.unionByName(good), taken.withColumn("error", F.lit("name taken or parent unknown"))


def stage_writes(plans: DataFrame, review: DataFrame) -> DataFrame:
    """Proposed writes with the review flags of their routing."""
    none = F.expr("cast(array() as array<string>)")
    r = plans.join(review.select("staged_id", F.col("review_required").alias("needs"), "review_reasons"), "staged_id", "left")
    empty = F.coalesce(F.size("claims"), F.lit(0)) <= 0
    return r.select(
        *[c for c in plans.columns if c not in ("status", "review_required", "risk_reasons", "warnings")],
        F.lit("proposed").alias("status"),
        (F.col("review_required") | F.coalesce("needs", F.lit(False))).alias("review_required"),
        F.concat(F.coalesce("risk_reasons", none), F.coalesce("review_reasons", none)).alias("risk_reasons"),
        F.concat(F.coalesce("warnings", none), F.when(empty, F.array(F.lit("No explicit atomic claims were staged."))).otherwise(none)).alias("warnings"))


def _judged(decisions: DataFrame, state: DataFrame) -> DataFrame:
    """Decisions with the status of their write and why they are refused (null: they are not)."""
    x = decisions.join(state.select("staged_id", "status", "review_required", "quarantine_release"), "staged_id")
    noted = F.length(F.trim(F.coalesce("notes", F.lit("")))) > 0
    status, action = F.col("status"), F.col("action")
    over = (status == "quarantined") & F.coalesce("override", F.lit(False)) & noted
    error = (
        F.when(action == "release", F.when(status != "quarantined", "not quarantined").when(~noted, "notes required"))
        .when(status.isin(*TERMINAL), "already final")
        .when(action == "apply", F.when(status == "quarantined", "quarantined").when(F.col("review_required"), "review required"))
        .when(action == "approve", F.when((status == "quarantined") & ~over, "quarantined").when(~status.isin(*REVIEWABLE, "quarantined"), "not reviewable"))
        .when(action == "reject", F.lit(None).cast("string"))
        .otherwise("unknown action"))
    return x.withColumn("error", error)


def decide(staged: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply review decisions; (updated staged writes with the last legal action in ``decided_by``, refused decisions with the reason).

    decisions: staged_id, action ('apply' | 'approve' | 'reject' | 'release'), reviewer, notes, override and seq, their
    order (without it, that of the actions' names).  Of a write's decisions the first legal one counts, and later ones are
    judged against the status it leads to.  At most a release and then a final decision can be legal, so two
    rounds settle every write, whatever the number of its decisions.
    """
    order = F.struct(*([F.col("seq")] if "seq" in decisions.columns else []), "action", "reviewer", "notes", "override")
    open_ = decisions.withColumn("at", order)
    # the rounds know a write by what decisions change; the rest of it is joined once, at the end
    changed = ["status", "review_required", "quarantine_release"]
    state, refused = staged.select("staged_id", *changed, F.lit(None).cast("string").alias("decided_by")), None
    action, status = F.col("action"), F.col("status")
    for _ in range(2):
        judged = _judged(open_, state)
        first = judged.where("error IS NULL").groupBy("staged_id").agg(F.min("at").alias("first"))
        judged = materialise(judged.join(first, "staged_id", "left"), "judged")
        none = judged.where("first IS NULL OR at < first")
        refused = none if refused is None else refused.unionByName(none)
        turn = judged.where("at = first").select("staged_id", "action").distinct()
        x = state.join(turn, "staged_id", "left")
        release = (
            F.when(action == "release", "released").when((action == "approve") & (status == "quarantined"), "approved_override")
            .when((action == "reject") & F.col("quarantine_release").isNotNull(), "rejected").otherwise(F.col("quarantine_release")))
        state = x.select(
            "staged_id",
            F.when(action.isin("apply", "approve"), "applied").when(action == "reject", "rejected").when(action == "release", "review_required").otherwise(status).alias("status"),
            F.when(action.isin("apply", "approve"), False).when(action == "release", True).otherwise(F.col("review_required")).alias("review_required"),
            release.alias("quarantine_release"), F.coalesce(action, "decided_by").alias("decided_by"))
        state = materialise(state, "decided-state")
        open_ = judged.where("first IS NOT NULL AND at > first").select(open_.columns)
    refused = refused.select("staged_id", "action", "status", "error").unionByName(_judged(open_, state).select("staged_id", "action", "status", "error"))
    unknown = decisions.join(staged.select("staged_id"), "staged_id", "left_anti").select("staged_id", "action", F.lit(None).cast("string").alias("status"), F.lit("unknown write").alias("error"))
    return staged.drop(*changed).join(state, "staged_id"), refused.unionByName(unknown)


def applied_claims(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger claims, sources) of applied writes: each write becomes one commit with its own source."""
    done = staged.where("status = 'applied'")
    parsed = staged_claims(done, [F.col("branch_id"), F.col("trust_score")]).where("claim_no IS NOT NULL AND error IS NULL")
    carried = [n for n in ("is_negation", "source_quote", "notes") if n in parsed.columns]
    claims = parsed.select(
        *carried, "claim_key", "subject", "predicate", F.col("staged_id").alias("seq"), F.col("claim_no").alias("ord"), "branch_id",
        F.col("staged_id").alias("source_id"), "trust_score", "object_value", "normalized_object", "confidence", "valid_from", "valid_to")
    sources = done.select(F.col("staged_id").alias("source_id"), F.lit("staged").alias("source_type"), "source_ref", "excerpt", "trust_score")
    return claims, sources


def commit_applied(store: LedgerStore, staged: DataFrame) -> int:
    """Write the claims of applied writes to a ledger, those it does not have yet; returns the epoch.

    A write is one commit, so what the log already holds of a write is all of it: repeated and killed runs add each write once.
    """
    claims, _ = applied_claims(staged)
    fresh = claims.join(store.log().select("seq").distinct(), "seq", "left_anti")
    return store.apply(fresh)
