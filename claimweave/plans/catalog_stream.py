"""Streaming queries: the batch results reached through micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.operators import ledger as L
from claimweave.operators.increment import LedgerStore
from claimweave.plans import catalog_checks as CC, catalog_ledger as CL, fixtures as fx
from claimweave.plans.registry import query
from claimweave.plans.session import scratch_path as scratch
from claimweave.streaming import ledger as SL

def _versions(store: LedgerStore):
    return L.versions_table(store.events()).select("claim_key", F.col("commit_seq").alias("version_seq"), "object_value", "status", CL.seq_of("supersedes_id").alias("supersedes_seq"))


_RUNS = CL.WITH_RUNS + """
SELECT claim_key, version_seq, object_value, status, supersedes_seq FROM isl"""
_UNDONE = CL.WITH_RUNS + """
SELECT claim_key, version_seq, object_value, supersedes_seq,
       CASE WHEN next_seq IS NULL THEN 'retracted' WHEN vno = n_versions - 1 THEN 'active' ELSE 'superseded' END AS status FROM isl"""


def _store(spark) -> LedgerStore:
    return LedgerStore(spark, scratch(spark, "store"), fx.branches(spark))


@query("fold_increment", _RUNS)
def fold_increment(spark, sf_dir):
    """The log in five batches, each folded from the states the one before left."""
    claims, store = CL.main_claims(spark, sf_dir), _store(spark)
    cuts = claims.agg(F.percentile_approx("seq", [i / 5 for i in range(1, 5)])).first()[0]
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = claims if low is None else claims.where(F.col("seq") > low)
        store.apply(part if high is None else part.where(F.col("seq") <= high))
    return _versions(store)


@query("fold_late", _UNDONE)
def fold_late(spark, sf_dir):
    """The log in three batches out of order: rollbacks come with the first batch, before most of what they undo."""
    claims, store = CL.main_claims(spark, sf_dir), _store(spark)
    for i in (2, 0, 1):
        store.apply(claims.where(F.col("seq") % 3 == i), CL.rollbacks(spark, sf_dir) if i == 2 else None)
    return _versions(store)


@query("stream_ledger", _RUNS)
def stream_ledger(spark, sf_dir):
    store, seen = _store(spark), scratch(spark, "stream-seen")
    for operations in SL.drops(SL.as_operations(CL.main_claims(spark, sf_dir)), "seq", scratch(spark, "claim-drops")):
        SL.drain_ledger(operations, store, seen)
    return _versions(store)


@query("stream_control", _UNDONE)
def stream_control(spark, sf_dir):
    """Claims and rollbacks on one stream; a quarter of the claims arrives after the rollbacks."""
    store, seen = _store(spark), scratch(spark, "control-seen")
    rows = SL.as_operations(CL.main_claims(spark, sf_dir), CL.rollbacks(spark, sf_dir))
    late = (F.col("op") == "claim") & (F.col("seq") % 4 == 0)
    arriving = rows.withColumn("arrival", F.when(late, F.col("seq") + 2 * CL.LATER).otherwise(F.col("seq")))
    for operations in SL.drops(arriving, "arrival", scratch(spark, "operation-drops")):
        SL.drain_ledger(operations, store, seen)
    return _versions(store)


@query("stream_checks", CC._RUN_ORACLE + """
SELECT staged_id, CASE status WHEN 'rejected' THEN 'reject' WHEN 'quarantined' THEN 'quarantine' WHEN 'review_required' THEN 'require_review' ELSE 'auto_apply' END AS decision FROM dec""")
def stream_checks(spark, sf_dir):
    out, state = scratch(spark, "stream-decisions"), scratch(spark, "check-state")
    for staged in SL.drops(CC.staged_writes(spark, sf_dir), "staged_id", scratch(spark, "proposal-drops"), parts=2):
        done = SL.stream_checks(staged, CC.snapshot(spark, sf_dir), out, state, today=CC.TODAY)
    return done.select("staged_id", "decision")
