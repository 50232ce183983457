"""Staged proposals stored with their claims as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CLAIM_ARRAY = ("array<struct<subject:string,predicate:string,object_value:string,object:string,confidence:decimal(6,4),"
               "valid_from:date,valid_to:date,is_negation:boolean,source_quote:string,notes:string>>")


def parse_claims(staged: DataFrame, column: str = "claims_json") -> DataFrame:
    """Typed ``claims`` from JSON; ``object`` is accepted for ``object_value``, malformed text gives no claims."""
    parsed = F.from_json(column, CLAIM_ARRAY)
    claims = F.transform(parsed, lambda c: F.struct(
        c["subject"].alias("subject"), c["predicate"].alias("predicate"), F.coalesce(c["object_value"], c["object"]).alias("object_value"),
        c["confidence"].alias("confidence"), c["valid_from"].alias("valid_from"), c["valid_to"].alias("valid_to"),
        c["is_negation"].alias("is_negation"), c["source_quote"].alias("source_quote"), c["notes"].alias("notes")))
    return staged.withColumn("claims", claims).drop(column)
