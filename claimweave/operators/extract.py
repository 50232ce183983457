"""Claims from plain sentences, by three transparent sentence forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.functions.text import find_date, parse_month_year, strip

NAME = r"[A-Z][\w\s.'-]*?"
# Sentence forms, confidence per form.
MOVED = rf"(?U)^({NAME})\s+moved\s+to\s+({NAME})(?:\s+in\s+([A-Za-z]+\s+\d{{4}}))?[.!]?$"
LIVES = rf"(?U)^({NAME})\s+(?:lives|resides)\s+in\s+({NAME})[.!]?$"
STAYS = rf"(?U)^(?:During\s+(.*?),\s+)?({NAME})\s+(?:will\s+)?stay\s+in\s+({NAME})[.!]?$"
SAYS = (r"(?iU)\b(?:also\s+)?(?:says|said|confirms|confirmed|reports|reported|states|stated|claims|claimed)\s+([A-Z][^.!?]*[.!?]?)$")
QUESTION = r"(?i)^(why|what|where|when|how|who)\b"


def is_question(message: Column) -> Column:
    """Read-only request: ends with "?" or opens with an asking word."""
    text = strip(message)
    return (text != "") & (text.endswith("?") | F.lower(text).rlike(
        r"^(why|what|where|when|how|who|which|show|list|display|explain|summarize|tell me)\b"))


def extract_claims(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per recognised sentence of each text; the input's other columns are kept."""
    body = strip(F.col(text))
    asking = body.endswith("?") | body.rlike(QUESTION)
    rows = texts.where((body != "") & ~asking).select(
        *[c for c in texts.columns if c != text], F.posexplode(F.split(body, r"(?U)(?<=[.!])\s+")).alias("sentence_no", "sentence"))
    rows = rows.withColumn("sentence", strip(F.col("sentence"))).where("sentence <> ''")
    said = F.regexp_extract("sentence", SAYS, 1)
    rows = rows.withColumn("core", F.when(F.col("sentence").rlike(SAYS), strip(said)).otherwise(F.col("sentence")))
    core = F.col("core")
    moved, lives, stays = core.rlike(MOVED), core.rlike(LIVES), core.rlike(STAYS)

    def part(form: str, n: int) -> Column:
        return strip(F.regexp_extract(core, form, n))

    def pick(m: Column, l: Column, s: Column) -> Column:
        return F.when(moved, m).when(lives, l).when(stays, s)

    when_text = F.when(part(MOVED, 3) != "", part(MOVED, 3)).otherwise(core)
    context = part(STAYS, 1)
    return rows.where(moved | lives | stays).select(
        *[c for c in rows.columns if c not in ("core", "sentence")],
        pick(part(MOVED, 1), part(LIVES, 1), part(STAYS, 2)).alias("subject"),
        pick(F.lit("lives_in"), F.lit("lives_in"), F.lit("stays_in")).alias("predicate"),
        pick(part(MOVED, 2), part(LIVES, 2), part(STAYS, 3)).alias("object_value"),
        pick(F.lit("0.82"), F.lit("0.75"), F.lit("0.68")).cast("decimal(6,4)").alias("confidence"),
        F.when(moved, parse_month_year(when_text)).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
        F.col("sentence").alias("source_quote"),
        pick(F.lit("moved-to form"), F.lit("lives-in form"), F.when(context != "", context).otherwise(F.lit("stay-in form"))).alias("notes"))


def date_claims(claims: DataFrame, session_date: str = "session_date") -> DataFrame:
    """Undated claims take the date of their session."""
    return claims.withColumn("valid_from", F.coalesce("valid_from", find_date(F.col(session_date))))
