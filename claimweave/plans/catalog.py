"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimweave.functions.scores import as_score
from claimweave.operators import ledger as L, reads as R
from claimweave.plans import catalog_checks, catalog_corpus, catalog_eval, catalog_ledger, catalog_stream, catalog_text, fixtures as fx  # noqa: F401
from claimweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold the claims of the events table, then the current version of every key on main with its score."""
    led = L.build_ledger(catalog_ledger.main_claims(spark, sf_dir), fx.branches(spark))
    scored = R.evidence_totals(led.versions.where(R.is_current()), led.direct, catalog_ledger.event_sources(spark, sf_dir), led.inherited)
    viewer = spark.sql("SELECT CAST(1 AS BIGINT) AS branch_id")
    visible = R.current_versions(scored, fx.branches(spark), viewer)
    return visible.select("claim_key", F.col("commit_seq").alias("version_seq"), "object_value", "status",
                          "active_support_count", as_score(F.col("score_units")).alias("score"))
