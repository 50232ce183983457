"""The gate for writes in order: each is checked against the ledger that all earlier accepted writes left.

A write's decision depends on earlier decisions only, so there is exactly one consistent set of decisions. It is found by rounds:
from the writes accepted in the last round the reducer replays each key once, from its stored state, with a *probe* in front of every
proposed claim that reports the versions visible at that place; facts, checks and decisions follow from the probes. Then only keys whose
accepted claims changed are replayed, and only writes that propose something for them (or repeat an excerpt) are decided
again. After ``n`` rounds all decisions with at most ``n`` accepted writes in front of them, one leaning on the other, are
right, so the rounds end; most writes lean on none.

Nothing is tied together: keys are replayed apart from each other even where writes link them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimweave.functions.scores import exact
from claimweave.functions.text import canonical_text
from claimweave.operators import checks as C, ledger as L
from claimweave.operators.policy import Policy
from claimweave.plans.session import materialise, ship_package, sized_broadcast


def _operations(proposed: DataFrame, accepted: DataFrame, base: int) -> DataFrame:
    """Probes of all proposed claims and the claims of accepted writes, in the reducer's columns.

    Write ``w`` probes at commit ``base + 2 w`` and commits at the next, after everything in the log.
    """
    seq = F.col("staged_id") * 2 + base
    empty = {"source_id": "long", "trust": "long", "object_value": "string", "normalized_object": "string", "conf": "long", "vf": "int", "vt": "int"}
    proposed = proposed.where("chain IS NOT NULL")  # an unknown branch holds nothing
    common = ["claim_key", F.lit(0).cast("long").alias("chunk"), "branch_id", "chain", "hyp", F.lit(False).alias("pinned"), F.lit(None).cast("long").alias("target")]
    pos = lambda s: (s * L.ORD_WIDTH + F.col("claim_no")).cast("long").alias("pos")
    probes = proposed.select(*common, pos(seq), F.lit("probe").alias("op"), F.lit(False).alias("shared"), *[F.lit(None).cast(t).alias(n) for n, t in empty.items()])
    taken = proposed.join(accepted, "staged_id", "left_semi")
    again = taken.groupBy("claim_key", "staged_id").agg((F.count("*") > 1).alias("shared"))
    claims = taken.join(again, ["claim_key", "staged_id"]).select(
        *common, pos(seq + 1), F.lit("claim").alias("op"), "shared", F.col("staged_id").alias("source_id"), exact(F.col("trust")).alias("trust"), "object_value",
        "normalized_object", exact(F.col("confidence")).alias("conf"), F.unix_date("valid_from").alias("vf"), F.unix_date("valid_to").alias("vt"))
    return probes.unionByName(claims)


def _facts(proposed: DataFrame, accepted: DataFrame, states: DataFrame, base: int, policy: Policy, options: L.FoldOptions) -> DataFrame:
    """``compared`` facts of the proposed claims given the accepted writes; all proposals of a key have to be there."""
    keys = proposed.select("claim_key").distinct()
    start = states.join(sized_broadcast(keys), "claim_key", "left_semi").select("claim_key", F.lit(0).cast("long").alias("chunk"), "state")
    seen = L.run_fold(_operations(proposed, accepted, base), start, options).where("kind = 'probe'")
    commit = F.shiftright("pos", L.fold.ORD_BITS)
    seen = seen.select(
        ((commit - base) / 2).cast("long").alias("staged_id"), F.col("pos").bitwiseAND(L.ORD_WIDTH - 1).cast("int").alias("claim_no"), F.col("normalized_object").alias("v_object"),
        F.date_from_unix_date("valid_from").alias("v_from"), F.date_from_unix_date("valid_to").alias("v_to"), F.col("trust").alias("score_units"), F.col("n").alias("active_support_count"))
    return C.compared(proposed.join(seen, ["staged_id", "claim_no"], "left"), policy)


def ordered_decisions(staged: DataFrame, states: DataFrame, branches: DataFrame, snapshot: C.Snapshot, *, today: str, policy: Policy | None = None,
                      base: int, messages: int | None = None, options: L.FoldOptions | None = None) -> DataFrame:
    """Decisions (as ``run_checks`` has them) of writes checked and applied one after the other by ``staged_id``.

    ``states``: ``claim_key, state`` of the ledger before the first write (``LedgerStore.states``, or ``end_states`` of a fold); ``base``:
    the first commit number after it. ``snapshot`` supplies what does not change in between: rolled-back content and stored sources.
    """
    ship_package(staged.sparkSession)
    policy, options = policy or Policy(), options or L.FoldOptions()
    staged = materialise(staged.where(~F.col("status").isin("applied", "rejected")), "ordered-writes")
    chains = sized_broadcast(L.branch_chains(branches))
    proposed = materialise(C.proposed_claims(staged, policy).join(chains, "branch_id", "left"), "proposed")
    states = materialise(states.join(sized_broadcast(proposed.select("claim_key").distinct()), "claim_key", "left_semi").select("claim_key", "state"), "gate-states")
    none = staged.select("staged_id").limit(0)
    excerpts = staged.select("staged_id", "excerpt")

    def decided(writes: DataFrame, facts: DataFrame, accepted: DataFrame) -> DataFrame:
        earlier = excerpts.join(accepted, "staged_id", "left_semi")
        x = C.CheckInput(writes, facts, snapshot, policy, today, earlier=earlier)
        return C.decided(C.failed_checks(x), policy.checks, messages=messages).select(*C.DECISION)

    accepted = none
    facts = materialise(_facts(proposed, none, states, base, policy, options), "gate-facts")
    decisions = materialise(decided(staged, facts, none), "gate-decisions")
    while True:
        now = materialise(decisions.where("decision = 'auto_apply'").select("staged_id"), "accepted")
        changed = materialise(now.exceptAll(accepted).union(accepted.exceptAll(now)), "changed")
        if changed.isEmpty():
            return decisions
        keys = proposed.join(sized_broadcast(changed), "staged_id", "left_semi").select("claim_key").distinct()
        on_keys = materialise(proposed.join(sized_broadcast(keys), "claim_key", "left_semi"), "gate-round")
        fresh = materialise(_facts(on_keys, now, states, base, policy, options), "fresh-facts")
        texts = excerpts.join(sized_broadcast(changed), "staged_id", "left_semi").select(canonical_text(F.col("excerpt")).alias("k")).where("k <> ''").distinct()
        repeats = excerpts.select("staged_id", canonical_text(F.col("excerpt")).alias("k")).join(sized_broadcast(texts), "k", "left_semi").select("staged_id")
        touched = materialise(fresh.select("staged_id").union(repeats).distinct(), "touched")
        facts = materialise(facts.join(fresh.select("staged_id", "claim_no"), ["staged_id", "claim_no"], "left_anti").unionByName(fresh), "gate-facts")
        again = decided(staged.join(sized_broadcast(touched), "staged_id", "left_semi"), facts.join(sized_broadcast(touched), "staged_id", "left_semi"), now)
        decisions = materialise(decisions.join(sized_broadcast(touched), "staged_id", "left_anti").unionByName(again), "gate-decisions")
        accepted = now
