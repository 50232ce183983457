"""Whole claims from raw text fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimweave.functions.scores import clamp
from claimweave.functions.text import canonical_text, claim_key, normalize_predicate, parse_iso_date, strip


def normalize_claims(raw: DataFrame) -> DataFrame:
    """Trimmed subject and object, labelled predicate, compared object, clamped confidence (default 0.7), typed dates.

    Other columns (negation, quote, notes, ...) are carried along.
    """
    own = {"subject", "predicate", "object_value", "confidence", "valid_from", "valid_to"}
    def day(name):
        return F.col(name) if dict(raw.dtypes)[name] == "date" else parse_iso_date(F.col(name))
    return raw.select(
        *[c for c in raw.columns if c not in own],
        claim_key(F.col("subject"), F.col("predicate")).alias("claim_key"), strip(F.col("subject")).alias("subject"),
        normalize_predicate(F.col("predicate")).alias("predicate"), strip(F.col("object_value")).alias("object_value"),
        canonical_text(F.col("object_value")).alias("normalized_object"),
        clamp(F.coalesce(F.col("confidence").cast("decimal(6,4)"), F.lit("0.7").cast("decimal(6,4)"))).cast("decimal(6,4)").alias("confidence"),
        day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"))
