"""Normalisation expressions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import scores as S, text as X
from claimweave.plans import fixtures as fx
from claimweave.plans.registry import query

EDGES = "' .,!?:;\"'''"


def sql_canonical(x: str) -> str:
    return f"trim(trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')), {EDGES})"


def sql_tokens(x: str) -> str:
    """The retrieval token set as a DuckDB expression."""
    stop = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
    words = f"regexp_extract_all({sql_canonical(x)}, '[a-z0-9]+')"
    stem = ("CASE WHEN regexp_full_match(t, '[0-9]+') OR length(t) <= 3 THEN t WHEN length(t) > 6 AND t LIKE '%ated' THEN concat(left(t, -4), 'ate') "
            "WHEN length(t) > 5 AND t LIKE '%ing' THEN left(t, -3) WHEN length(t) > 4 AND t LIKE '%ed' THEN left(t, -2) "
            "WHEN length(t) > 5 AND t LIKE '%ies' THEN concat(left(t, -3), 'y') WHEN length(t) > 4 AND t LIKE '%s' THEN left(t, -1) ELSE t END")
    return f"list_distinct(list_transform(list_filter({words}, lambda t: t NOT IN ({stop})), lambda t: {stem}))"


@query("canonical_text", f"SELECT doc_id, {sql_canonical('text')} AS canonical FROM documents")
def canonical_text(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", X.canonical_text(F.col("text")).alias("canonical"))


_RAW_PREDICATES = ("lives in", "Current_Residence ", "moved to", "  HOME CITY!", "favorite color", "due-date", "will  stay in", "works @ place", "Based_in", "it's \"odd\"")
_LABELS = ("lives_in", "lives_in", "lives_in", "lives_in", "favorite_color", "due_date", "stays_in", "works_place", "lives_in", "it_s_odd")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PREDICATE_CTE = "WITH pr AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_q(r)}, {_q(l)})" for i, (r, l) in enumerate(zip(_RAW_PREDICATES, _LABELS))) + ") AS t(i, raw, label))\n"


def raw_claims(spark, sf_dir):
    """Claims as a model might write them: stray blanks, mixed case, spelling variants, out-of-range confidence."""
    e = fx.table(spark, sf_dir, "events")
    eid = F.col("event_id")
    raw = F.element_at(F.array(*[F.lit(p) for p in _RAW_PREDICATES]), (eid % len(_RAW_PREDICATES) + 1).cast("int"))
    return e.select(
        eid.alias("seq"), F.concat(F.lit("  User "), F.col("user_id"), F.lit("!  ")).alias("subject"), raw.alias("predicate"),
        F.concat(F.lit(" \"Obj  "), (eid % 4).cast("string"), F.lit("\". ")).alias("object_value"),
        F.when(eid % 5 != 0, (F.col("event_id") % 30).cast("int") * F.lit("0.05").cast("decimal(3,2)")).alias("confidence"),
        F.when(eid % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(eid % 3 == 1, F.lit("soon")).otherwise(F.lit("2024-02-31")).alias("valid_from"),
        F.lit(None).cast("string").alias("valid_to"), (eid % 2 == 0).alias("is_negation"))


@query("normalize_claims", _PREDICATE_CTE + """
SELECT event_id AS seq, concat('user ', user_id, '::', label) AS claim_key, concat('User ', user_id, '!') AS subject, label AS predicate,
       concat('"Obj  ', event_id % 4, '".') AS object_value, concat('obj ', event_id % 4) AS normalized_object,
       CAST(CASE WHEN event_id % 5 = 0 THEN 0.7 ELSE least(1, CAST(event_id % 30 AS INT) * 0.05) END AS DOUBLE) AS confidence,
       CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) END AS valid_from, event_id % 2 = 0 AS is_negation
FROM events JOIN pr ON pr.i = event_id % 10""")
def normalize_claims(spark, sf_dir):
    from claimweave.operators.normalize import normalize_claims as run
    return run(raw_claims(spark, sf_dir)).select(
        "seq", "claim_key", "subject", "predicate", "object_value", "normalized_object", F.col("confidence").cast("double").alias("confidence"), "valid_from", "is_negation")


@query("normalize_predicate", _PREDICATE_CTE + "SELECT event_id AS seq, label FROM events JOIN pr ON pr.i = event_id % 10")
def normalize_predicate(spark, sf_dir):
    return raw_claims(spark, sf_dir).select("seq", X.normalize_predicate(F.col("predicate")).alias("label"))


@query("claim_key", _PREDICATE_CTE + "SELECT event_id AS seq, concat('user ', user_id, '::', label) AS claim_key FROM events JOIN pr ON pr.i = event_id % 10")
def claim_key(spark, sf_dir):
    return raw_claims(spark, sf_dir).select("seq", X.claim_key(F.col("subject"), F.col("predicate")).alias("claim_key"))


@query("parse_month_year", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 2 = 1")
def parse_month_year(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Placed in "), F.date_format("o_orderdate", "MMMM yyyy"), F.lit(", shipped in May 1970.")))
    text = text.otherwise(F.concat(F.lit("Placed in "), F.date_format("o_orderdate", "yyyy")))
    return o.select("o_orderkey", X.parse_month_year(text).alias("month_start"))


@query("parse_dates", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(ts AS DATE) END AS iso, CASE WHEN event_id % 4 < 3 THEN CAST(ts AS DATE) END AS found FROM events""")
def parse_dates(spark, sf_dir):
    """Strict ISO dates, and the first date inside a text in either spelling."""
    e = fx.table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    text = (F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, F.date_format("ts", "yyyy/M/d (E) HH:mm"))
            .when(k == 2, F.concat(F.lit("on "), F.date_format("ts", "yyyy-M-d"))).otherwise(F.lit("2024/13/40")))
    return e.select("event_id", X.parse_iso_date(text).alias("iso"), X.find_date(text).alias("found"))


@query("belief_score", "SELECT event_id, CAST(round(CAST(CAST(CAST(event_id % 20 + 1 AS INT) * 0.05 AS DECIMAL(6,4)) * CAST(CAST(user_id % 97 AS INT) * 0.0101 AS DECIMAL(6,4)) AS DECIMAL(18,8)), 4) AS DOUBLE) AS score FROM events")
def belief_score(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    conf = ((F.col("user_id") % 97).cast("int") * F.lit("0.0101").cast("decimal(5,4)")).cast("decimal(6,4)")
    return e.select("event_id", S.belief_score(fx.decimal_step(F.col("event_id") % 20 + 1), conf).alias("score"))


@query("clamp", "SELECT vec_id, i, greatest(0, least(1, CAST(CAST(x AS DOUBLE) * 20 AS DECIMAL(18,6))))::DOUBLE AS clamped FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)")
def clamp(spark, sf_dir):
    v = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return v.select("vec_id", F.col("i").cast("long").alias("i"), S.clamp((F.col("x").cast("double") * 20).cast("decimal(18,6)")).cast("double").alias("clamped"))


@query("dedupe_reasons", "SELECT event_id, concat_ws('|', event_type, CASE WHEN event_type <> 'click' THEN 'click' END, concat('u', user_id % 3)) AS reasons FROM events")
def dedupe_reasons(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    u = F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string"))
    raw = F.array(F.col("event_type"), F.lit(""), F.lit("click"), u, F.lit(None).cast("string"), F.col("event_type"), u)
    return e.select("event_id", F.array_join(X.distinct_nonempty(raw), "|").alias("reasons"))


@query("compact_text", """
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) > 140 THEN concat(substr(s, 1, 140), '...') ELSE s END AS shortened,
       CASE WHEN length(s) > 420 THEN concat(substr(s, 1, 417), '...') ELSE s END AS compacted FROM t""")
def compact_text(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", X.shorten(F.col("text")).alias("shortened"), X.compact(F.col("text"), 420).alias("compacted"))


@query("source_label", """
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s, CASE doc_id % 4 WHEN 0 THEN concat('chat-', doc_id) WHEN 1 THEN NULL WHEN 2 THEN source ELSE concat('source-', doc_id) END AS ref FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN ref WHEN s <> '' THEN CASE WHEN length(s) > 140 THEN concat(substr(s, 1, 140), '...') ELSE s END
       WHEN ref IS NOT NULL THEN ref ELSE concat('source-', doc_id) END AS label FROM t""")
def source_label(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    k, doc = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    ref = F.when(k == 0, F.concat(F.lit("chat-"), doc)).when(k == 2, F.col("source")).when(k == 3, F.concat(F.lit("source-"), doc))
    return d.select("doc_id", X.source_label(ref, F.col("text"), F.col("doc_id")).alias("label"))


@query("safe_branch_name", """
WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(trim(text)), '_', '-'), '[^\\p{L}\\p{N}-]', '', 'g'), '-+', '-', 'g'), '-') AS s FROM documents)
SELECT doc_id, CASE WHEN s = '' THEN 'main' ELSE left(s, 40) END AS branch FROM t""")
def safe_branch_name(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", X.safe_branch_name(F.col("text")).alias("branch"))


@query("tokens", f"SELECT doc_id, list_sort({sql_tokens('text')}) AS tokens FROM documents")
def tokens(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.array_sort(X.tokens(F.col("text"))).alias("tokens"))


@query("relative_date_targets", """
SELECT event_id, CAST(ts AS DATE) - CAST(event_id % 9 AS INT) AS target FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, CAST(ts AS DATE) - 14 FROM events WHERE event_id % 3 = 1
UNION ALL SELECT event_id, CAST(ts AS DATE) - 90 FROM events WHERE event_id % 3 = 2
UNION ALL SELECT event_id, CAST(ts AS DATE) - 1 FROM events WHERE event_id % 3 = 2""")
def relative_date_targets(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    k = F.col("event_id") % 3
    question = (F.when(k == 0, F.concat(F.lit("What happened "), (F.col("event_id") % 9).cast("string"), F.lit(" days ago?")))
                .when(k == 1, F.lit("What did I buy Two weeks ago?")).otherwise(F.lit("Was it three months ago or yesterday?")))
    return e.select("event_id", F.explode(X.relative_date_targets(question, F.col("ts").cast("date"))).alias("target"))
