"""Ledger inputs derived from the analytic tables (events, documents, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimweave.functions.text import canonical_text, claim_key
from claimweave.plans.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; those that feed text work use all cores even when they are one small file."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("events", "documents") else df


def decimal_step(expr, step: str = "0.05"):
    return (expr.cast("int") * F.lit(step).cast("decimal(3,2)")).cast("decimal(6,4)")


def event_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dated claim per event: who it is about, what kind, one of four values."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("subject"),
        F.col("event_type").alias("predicate"),
        F.concat(F.lit("obj_"), (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 4).cast("string")).alias("object_value"),
        decimal_step(F.col("event_id") % 20 + 1).alias("trust_score"),
        (F.lit("0.5").cast("decimal(2,1)") + (F.col("user_id") % 6).cast("int") * F.lit("0.1").cast("decimal(2,1)"))
        .cast("decimal(6,4)").alias("confidence"),
        F.col("ts").cast("date").alias("valid_from"),
        F.col("event_id").alias("source_id"),
        F.when(F.col("user_id") % 5 == 0, 2).otherwise(1).cast("long").alias("branch_id"),
    )


def as_ledger_claims(claims: DataFrame) -> DataFrame:
    """Adapt subject/predicate claims to the ledger's input columns."""
    has = claims.columns
    return claims.select(
        claim_key(F.col("subject"), F.col("predicate")).alias("claim_key"),
        "subject", "predicate", "seq",
        F.col("ord") if "ord" in has else F.lit(0).alias("ord"),
        F.col("branch_id") if "branch_id" in has else F.lit(1).cast("long").alias("branch_id"),
        "source_id", "trust_score", "object_value",
        canonical_text(F.col("object_value")).alias("normalized_object"),
        "confidence", "valid_from",
        F.col("valid_to") if "valid_to" in has else F.lit(None).cast("date").alias("valid_to"),
    )


def branches(spark: SparkSession) -> DataFrame:
    """main <- trial <- trial-child."""
    return spark.sql("""SELECT CAST(id AS BIGINT) AS id, name, CAST(parent AS BIGINT) AS parent_branch_id, 'active' AS status
        FROM VALUES (1, 'main', NULL), (2, 'trial', 1), (3, 'trial-child', 2) AS t(id, name, parent)""")


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as provenance sources, trust from their labels."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trust = (
        F.when(F.col("quality").isNull(), 0.6)
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), 0.9)
        .when(F.col("quality") == 1, 0.5)
        .otherwise(0.3)
    )
    return d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("source_id"), F.lit("document").alias("source_type"), F.col("source").alias("source_ref"),
        F.col("text").alias("excerpt"), trust.cast("decimal(6,4)").alias("trust_score"))
