"""Evidence lines per question family, and reductions over evidence candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.functions.text import canonical_text, compact, find_date, relative_date_targets, squeeze, tokens
from claimweave.operators.retrieve import is_money_total
from claimweave.sources.corpus import first_per_group

# Wording of evidence lines.
AGE = (r"(?i)\b(\d+\s*(?:years?\s*old|year-old)|turned\s+\d+|in\s+my\s+\d+0s|\d+\s+is\s+considered|\d+(?:st|nd|rd|th)\s+birthday|"
       r"(?:am|is|are|was|were|just|currently)\s+\d+)\b")
AMOUNT = r"(?i)\$\s*\d+(?:\.\d+)?|\b\d+(?:\.\d+)?\s*dollars?\b|\b\d+\s+\w+(?:\s+\w+){0,4}\s+for\s+\$\s*\d"
SALE = r"(?i)\b(earn(?:ed|ing)?|sold|sale|sales|market|vendor|customer|revenue|profit)\b"
GOT = r"(?i)\b(bought|buy|purchased|got|ordered|acquired|downloaded|booked|started|finished|completed)\b"
HAPPENED = (r"(?i)\b(cancelled|canceled|ordered|did an online|bought|purchased|downloaded|got|acquired|invested|attended|visited|met|started|"
            r"finished|completed|booked|arrived|left)\b")
MUSIC_QUESTION = r"\b(album|albums|ep|eps|music|song|songs|vinyl|record|records)\b"
MUSIC_THING = r"(?i)\b(album|albums|ep|eps|vinyl|record|records|spotify|band|artist)\b"
MUSIC_GOT = r"(?i)\b(downloaded|purchased|bought|buying|acquired|owned|own|got|signed)\b"
COUNTED = (r"(?i)\b(downloaded|purchased|bought|buying|acquired|ordered|cancelled|canceled|booked|attended|visited|met|won|finished|completed|"
           r"created|started|got)\b")
PLACE_QUESTION = r"\b(hotel|restaurant|trip|travel|stay|visit|venue|place|activity)\b"
PREFERENCE = (r"(?i)\b(prefer|like|love|want|need|looking for|interested in|stick with|sounds amazing|great view|views?|skyline|ocean|rooftop|"
              r"pool|hot tub|balcony|fireplace|breakfast|package|perk|unique|dietary|near|close to)\b")
AGE_QUESTION = r"\b(age|old|older|younger|born|birthday)\b"
COUNT_QUESTION = r"\b(how many|count|number of)\b"
PREFERENCE_QUESTION = r"\b(suggest|recommend|recommendation|where should|what should)\b"
DURATION_QUESTION = (
    r"\b(days?|weeks?|months?|years?)\b.*\b(passed|between|elapsed|after|before)\b|\bbetween\b.*\b(days?|weeks?|months?|years?)\b"
    r"|\bhow many\s+(days?|weeks?|months?|years?)\b.*\b(when|until|since|by the time)\b"
    r"|\b(days?|weeks?|months?|years?)\b.*\b(have i been|had i been|when i|when did|ago)\b")
GENERIC_TIME = ("many", "much", "day", "days", "week", "weeks", "month", "months", "year", "years", "been", "when", "between", "passed", "elapsed",
                "after", "before", "have", "had")


def candidate_lines(sources: DataFrame) -> DataFrame:
    """Sources exploded to their sentences and lines, in order; session headers and blanks left out."""
    rows = sources.select(*[c for c in sources.columns if c != "excerpt"],
                          F.posexplode(F.split("excerpt", r"(?U)\n|(?<=[.!?])\s+")).alias("line_no", "raw"))
    return rows.withColumn("line", squeeze(F.col("raw"))).drop("raw").where((F.col("line") != "") & ~F.col("line").startswith("[Session"))


def _dedupe(lines: DataFrame, cap: int | None, limit: int | None, order: list[str]) -> DataFrame:
    """First of equal whole lines per (question, source), shown in at most ``limit`` characters; the first ``cap`` of each question."""
    shown = F.col("line") if limit is None else compact(F.col("line"), limit)
    keyed = lines.withColumn("evidence", shown).withColumn("norm", canonical_text(F.col("line")))
    first = keyed.groupBy("question_id", "source_ref", "norm").agg(F.min(F.struct(*order, "session_date", "evidence")).alias("f"))
    rows = first.select("question_id", "source_ref", *[F.col(f"f.{c}").alias(c) for c in order], "f.session_date", "f.evidence")
    return (rows if cap is None else first_per_group(rows, ["question_id"], order, cap)).drop(*order)


ORDER = ["place", "line_no"]


def evidence_age(lines: DataFrame, cap: int | None = None, limit: int | None = None) -> DataFrame:
    return _dedupe(lines.where(F.col("line").rlike(AGE)), cap, limit, ORDER)


def evidence_money(lines: DataFrame, cap: int | None = None, limit: int | None = None) -> DataFrame:
    return _dedupe(lines.where(F.col("line").rlike(AMOUNT) & F.col("line").rlike(SALE)), cap, limit, ORDER)


def evidence_relative_date(lines: DataFrame, questions: DataFrame, cap: int | None = None, limit: int | None = None) -> DataFrame:
    q = questions.select("question_id", tokens(F.col("question")).alias("q"),
                         relative_date_targets(F.col("question"), find_date(F.col("question_date"))).alias("targets"))
    x = lines.join(q, "question_id").where(F.array_contains("targets", find_date(F.col("session_date"))))
    return _dedupe(x.where(F.col("line").rlike(GOT) | (F.size(F.array_intersect("q", tokens(F.col("line")))) > 0)), cap, limit, ORDER)


def evidence_temporal(lines: DataFrame, questions: DataFrame, cap: int | None = None, limit: int | None = None) -> DataFrame:
    q = questions.select("question_id", tokens(F.col("question")).alias("q"))
    x = lines.where("session_date IS NOT NULL AND session_date <> ''").join(q, "question_id")
    x = x.withColumn("common", F.array_intersect("q", tokens(F.col("line"))))
    x = x.withColumn("specific", F.size(F.array_except("common", F.array(*[F.lit(t) for t in GENERIC_TIME]))))
    x = x.where(F.col("line").rlike(HAPPENED) & ((F.col("specific") > 0) | (F.size("common") >= 3)))
    return _dedupe(x.withColumn("rank", -(F.col("specific") * 2 + F.size("common"))), cap, limit, ["rank", *ORDER])


def evidence_count(lines: DataFrame, questions: DataFrame, cap: int | None = None, limit: int | None = None) -> DataFrame:
    x = lines.join(questions.select("question_id", F.lower("question").rlike(MUSIC_QUESTION).alias("music")), "question_id")
    line = F.col("line")
    hit = F.when(F.col("music"), line.rlike(MUSIC_GOT) & line.rlike(MUSIC_THING)).otherwise(line.rlike(COUNTED))
    return _dedupe(x.where(hit), cap, limit, ORDER)


def evidence_preference(lines: DataFrame, questions: DataFrame, cap: int | None = None, limit: int | None = None) -> DataFrame:
    asked = questions.where(F.lower("question").rlike(PLACE_QUESTION)).select("question_id")
    return _dedupe(lines.join(asked, "question_id", "left_semi").where(F.col("line").rlike(PREFERENCE)), cap, limit, ORDER)


def question_families(questions: DataFrame) -> DataFrame:
    """Which evidence jobs a question calls for: one main family, plus preference."""
    low = F.lower("question")
    dated = F.size(relative_date_targets(F.col("question"), find_date(F.col("question_date")))) > 0
    family = (
        F.when(low.rlike(AGE_QUESTION), "age").when(is_money_total(F.col("question")), "money")
        .when(dated, "relative_date").when(low.rlike(DURATION_QUESTION), "temporal").when(low.rlike(COUNT_QUESTION), "count"))
    return questions.select("question_id", family.alias("family"),
                            low.rlike(PREFERENCE_QUESTION).alias("preference"))


# -- reductions over evidence candidates ------------------------------------------------

def candidate_date(event_date: Column, session_date: Column) -> Column:
    return F.coalesce(find_date(event_date), find_date(session_date))


def _dated(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("day", candidate_date(F.col("event_date"), F.col("session_date"))).where("day IS NOT NULL AND role <> 'distractor'")


def reduce_sum(candidates: DataFrame) -> DataFrame:
    """Total of the amounts, a missing one being quantity * unit price."""
    dec = "decimal(18,4)"
    amount = F.coalesce(F.col("amount").cast(dec), (F.col("quantity").cast(dec) * F.col("unit_price").cast(dec)).cast(dec))
    rows = candidates.where("role <> 'distractor'").withColumn("value", amount).where("value IS NOT NULL")
    return rows.groupBy("question_id").agg(F.count("*").alias("n_addends"), F.sum("value").cast("double").alias("total"))


def reduce_order(candidates: DataFrame) -> DataFrame:
    """The earliest dated candidate per question (first listed among equals)."""
    return _dated(candidates).groupBy("question_id").agg(
        F.count("*").alias("n_dated"), F.min(F.struct("day", "place", "event_name")).alias("f")).select(
        "question_id", "n_dated", F.col("f.event_name").alias("earliest"), F.col("f.day").alias("earliest_date"))


def reduce_duration(candidates: DataFrame) -> DataFrame:
    """Days and weeks from the first to the last dated candidate; needs two."""
    d = _dated(candidates).groupBy("question_id").agg(F.count("*").alias("n"), F.min("day").alias("start_date"), F.max("day").alias("end_date")).where("n >= 2")
    days = F.datediff("end_date", "start_date")
    return d.select("question_id", "start_date", "end_date", days.alias("elapsed_days"), F.round(days / 7, 4).alias("elapsed_weeks"))


def reduce_count_bounded(candidates: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct targets strictly before/after the earliest anchor; undated targets, and all of them without an anchor, count."""
    c = candidates.withColumn("day", candidate_date(F.col("event_date"), F.col("session_date")))
    anchors = c.where("role = 'anchor'").groupBy("question_id").agg(F.min("day").alias("anchor_date"))
    x = c.where("role = 'target'").join(anchors, "question_id", "left").join(relations.select("question_id", F.lower("temporal_relation").alias("rel")), "question_id", "left")
    bound = F.col("anchor_date").isNotNull() & F.col("day").isNotNull()
    rel = F.coalesce("rel", F.lit(""))
    out = bound & ((F.contains(rel, F.lit("before")) & ~(F.col("day") < F.col("anchor_date"))) | (F.contains(rel, F.lit("after")) & ~(F.col("day") > F.col("anchor_date"))))
    label = F.coalesce(F.when(F.col("event_name") != "", F.col("event_name")), F.when(F.col("object_value") != "", F.col("object_value")), F.col("evidence"))
    return x.where(~out).groupBy("question_id").agg(F.max("anchor_date").alias("anchor_date"), F.count_distinct(canonical_text(label)).alias("n"))


def reduce_filter_date(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """Candidates dated on one of the dates the question means."""
    q = questions.select("question_id", relative_date_targets(F.col("question"), find_date(F.col("question_date"))).alias("targets"))
    return _dated(candidates).join(q, "question_id").where(F.array_contains("targets", F.col("day"))).drop("targets")
