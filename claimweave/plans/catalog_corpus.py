"""Corpus, extraction, retrieval and evidence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimweave.operators import evidence as E, extract as X, reads as R, retrieve as RV
from claimweave.plans import catalog_ledger as CL, fixtures as fx
from claimweave.plans.catalog_text import sql_canonical, sql_tokens
from claimweave.plans.registry import once, query
from claimweave.plans.session import materialise, scratch_path as scratch
from claimweave.sources import corpus as S
from claimweave.sources.export import export_csv, export_jsonl


# -- corpus files -----------------------------------------------------------------------

TYPES = S.QUESTION_TYPES
CORPUS_CTE = "WITH ty AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TYPES)) + """) AS t(i, question_type)),
cv AS (SELECT conv_id // 10 AS q, conv_id % 10 AS session_index, turn, role, text FROM conversations),
rec AS (SELECT q, concat('q', lpad(CAST(q AS VARCHAR), 9, '0'), CASE WHEN q % 7 = 0 THEN '_abs' ELSE '' END) AS question_id, question_type,
               max(session_index) + 1 AS n_sessions, count(*) AS n_turns, concat('2024-0', 1 + q % 9, '-15') AS question_date
        FROM cv JOIN ty ON ty.i = q % 6 GROUP BY q, question_type)
"""


def corpus_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbouring conversations make one record; each conversation is a session."""
    c = fx.table(spark, sf_dir, "conversations")
    q = F.floor(F.col("conv_id") / 10)
    sessions = c.groupBy(q.alias("q"), (F.col("conv_id") % 10).alias("s")).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
                              lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"), (t["turn"] == 1).alias("has_answer")))).alias("session"))
    rows = sessions.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("s", "session"))).alias("x"))
    qid = F.concat(F.lit("q"), F.lpad(F.col("q").cast("string"), 9, "0"), F.when(F.col("q") % 7 == 0, "_abs").otherwise(""))
    return rows.select(
        qid.alias("question_id"), F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("q") % 6 + 1).cast("int")).alias("question_type"),
        F.concat(F.lit("What is known about record "), F.col("q").cast("string"), F.lit("?")).alias("question"), F.lit("nothing").alias("answer"),
        F.concat(F.lit("2024-0"), (F.col("q") % 9 + 1).cast("string"), F.lit("-15")).alias("question_date"),
        F.transform("x", lambda e: F.concat(F.lit("s"), e["s"].cast("string"))).alias("haystack_session_ids"),
        F.transform("x", lambda e: F.concat(F.lit("2023/06/0"), (e["s"] % 9 + 1).cast("string"), F.lit(" (Sat) 18:26"))).alias("haystack_dates"),
        F.transform("x", lambda e: e["session"]).alias("haystack_sessions"), F.array(F.lit("s0")).alias("answer_session_ids"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records written as JSON lines and read back through the corpus reader."""
    def build():
        path = scratch(spark, "corpus")
        raw = corpus_records(spark, sf_dir)
        nested = raw.withColumn("haystack_sessions", F.transform("haystack_sessions", lambda s: F.from_json(s, "array<struct<role:string,content:string,has_answer:boolean>>")))
        nested.write.json(path)
        return materialise(S.read_corpus(spark, path, lines=True), "records")
    return once(spark, "corpus", sf_dir, build=build)


def corpus_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, "turns", sf_dir, build=lambda: materialise(S.session_turns(corpus(spark, sf_dir)), "turns"))


@query("scan_sessions", CORPUS_CTE + """
SELECT question_id, CAST(session_index AS INT) AS session_index, CAST(turn AS INT) AS turn_index, role, text AS content FROM cv JOIN rec ON rec.q = cv.q""")
def scan_sessions(spark, sf_dir):
    return corpus_turns(spark, sf_dir).select("question_id", "session_index", "turn_index", "role", "content")


@query("scan_jsonl", "SELECT concat('d', doc_id) AS question_id, text AS hypothesis, CASE WHEN quality IS NOT NULL THEN quality = 1 END AS label FROM documents LEFT JOIN labels USING (doc_id)")
def scan_jsonl(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").join(fx.table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = d.select(F.concat(F.lit("d"), "doc_id").alias("question_id"), F.col("text").alias("hypothesis"),
                    F.when(F.col("quality").isNotNull(), F.struct((F.col("quality") == 1).alias("label"))).alias("autoeval_label"))
    path = export_jsonl(rows, scratch(spark, "jsonl"))
    return S.read_hypotheses(spark, path).select("question_id", "hypothesis", F.col("autoeval_label.label").alias("label"))


@query("resume_append", "SELECT concat('e', event_id) AS question_id, event_type AS hypothesis FROM events")
def resume_append(spark, sf_dir):
    """A run interrupted after two of three rows, resumed: every id is answered exactly once."""
    e = fx.table(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id").alias("question_id"), F.col("event_type").alias("hypothesis"), "event_id")
    path = export_jsonl(e.where("event_id % 3 <> 0").drop("event_id"), scratch(spark, "resume"))
    export_jsonl(S.resume_append(e.drop("event_id"), S.read_hypotheses(spark, path)), path)
    return S.read_hypotheses(spark, path).select("question_id", "hypothesis")


@query("select_shard", "SELECT doc_id, position FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position FROM documents) WHERE position > 50 AND position <= 150")
def select_shard(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id")
    return S.select_shard(d, "doc_id", start_index=50, limit=100).select("doc_id", "position")


@query("append_log", "SELECT concat('e', event_id) AS question_id, event_type AS hypothesis FROM events")
def append_log(spark, sf_dir):
    """Three runs with overlapping rows append to one log: every id is in it once."""
    e = fx.table(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id").alias("question_id"), F.col("event_type").alias("hypothesis"), "event_id")
    path = scratch(spark, "append-log")
    for part in (e.where("event_id % 3 <> 0"), e.where("event_id % 2 = 0"), e):
        log = S.append_log(part.drop("event_id"), path)
    return log


@query("select_sample", "SELECT doc_id, source FROM documents ORDER BY md5(concat('7:', doc_id)), doc_id LIMIT 50")
def select_sample(spark, sf_dir):
    return S.select_sample(fx.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 50, seed=7)


@query("export_csv", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name FROM supplier")
def export_csv_query(spark, sf_dir):
    s = fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    path = export_csv(s, scratch(spark, "csv"))
    return spark.read.schema("s_name string, s_suppkey long").option("header", "true").csv(path)


@query("corpus_stats", CORPUS_CTE + """
SELECT 'record_count' AS item, CAST(count(*) AS DOUBLE) AS value FROM rec UNION ALL SELECT 'abstention_count', CAST(count(*) FILTER (WHERE q % 7 = 0) AS DOUBLE) FROM rec
UNION ALL SELECT 'avg_sessions', round(avg(n_sessions), 4) FROM rec UNION ALL SELECT 'max_sessions', CAST(max(n_sessions) AS DOUBLE) FROM rec
UNION ALL SELECT 'avg_turns', round(avg(n_turns), 4) FROM rec UNION ALL SELECT 'max_turns', CAST(max(n_turns) AS DOUBLE) FROM rec
UNION ALL SELECT concat('type:', question_type), CAST(count(*) AS DOUBLE) FROM rec GROUP BY question_type""")
def corpus_stats(spark, sf_dir):
    return S.corpus_stats(corpus(spark, sf_dir), corpus_turns(spark, sf_dir))


_PROMPT_HEAD = "concat_ws(chr(10), " + ", ".join("'" + line + "'" for line in S.INSTRUCTIONS) + ", concat('Question date: ', question_date), concat('Question type: ', question_type), 'History:', "


@query("prompt_rows", CORPUS_CTE + """
, ss AS (SELECT q, session_index, concat('[Session ', session_index, ' | 2023/06/0', session_index % 9 + 1, ' (Sat) 18:26]', chr(10), string_agg(concat(role, ': ', text), chr(10) ORDER BY turn), chr(10)) AS block FROM cv GROUP BY q, session_index)
, hh AS (SELECT ss.q, string_agg(block, chr(10) ORDER BY session_index) AS history FROM ss JOIN rec ON rec.q = ss.q WHERE session_index >= n_sessions - 3 GROUP BY ss.q)
SELECT question_id, """ + _PROMPT_HEAD + """history, 'Question:', concat('What is known about record ', rec.q, '?'), 'Answer:') AS prompt FROM rec JOIN hh ON hh.q = rec.q""")
def prompt_rows(spark, sf_dir):
    p = S.prompt_rows(corpus(spark, sf_dir), corpus_turns(spark, sf_dir), max_sessions=3, history_format="nl")
    return p.select("question_id", "prompt")


@query("prompt_rows_json", CORPUS_CTE + """
, ss AS (SELECT q, session_index, concat('{"session_index":', session_index, ',"date":"2023/06/0', session_index % 9 + 1, ' (Sat) 18:26","turns":[', string_agg(concat('{"role":', CAST(to_json(role) AS VARCHAR), ',"content":', CAST(to_json(text) AS VARCHAR), '}'), ',' ORDER BY turn), ']}') AS block FROM cv GROUP BY q, session_index)
, hh AS (SELECT ss.q, concat('[', string_agg(block, ',' ORDER BY session_index), ']') AS history FROM ss GROUP BY ss.q)
SELECT question_id, """ + _PROMPT_HEAD + """history, 'Question:', concat('What is known about record ', rec.q, '?'), 'Answer:') AS prompt FROM rec JOIN hh ON hh.q = rec.q""")
def prompt_rows_json(spark, sf_dir):
    return S.prompt_rows(corpus(spark, sf_dir), corpus_turns(spark, sf_dir)).select("question_id", "prompt")


# -- extraction -------------------------------------------------------------------------

def claim_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event texts in the sentence forms the extractor knows, with noise around them."""
    e = fx.table(spark, sf_dir, "events")
    k, u, n = F.col("event_id") % 6, F.concat(F.lit("User"), F.col("user_id").cast("string")), (F.col("event_id") % 9).cast("string")
    city = F.concat(F.lit("City"), n)
    text = (
        F.when(k == 0, F.concat(u, F.lit(" moved to "), city, F.lit(" in March 2026. Nothing else happened.")))
        .when(k == 1, F.concat(F.lit("It rained today. "), u, F.lit(" lives in "), city, F.lit("! "), u, F.lit(" will stay in Hotel"), n, F.lit(".")))
        .when(k == 2, F.concat(F.lit("During the fair, "), u, F.lit(" will stay in "), city, F.lit(".")))
        .when(k == 3, F.concat(F.lit("Where does "), u, F.lit(" live?")))
        .when(k == 4, F.concat(F.lit("The office also confirmed "), u, F.lit(" resides in "), city, F.lit(".")))
        .otherwise(F.concat(F.lit("what "), u, F.lit(" lives in is unknown."))))
    return e.select("event_id", F.date_format("ts", "yyyy/MM/dd (E) HH:mm").alias("session_date"), text.alias("text"))


@query("extract_claims", """
WITH t AS (SELECT event_id, event_id % 6 AS k, concat('User', user_id) AS u, concat('City', event_id % 9) AS city, event_id % 9 AS n FROM events)
SELECT event_id, u AS subject, 'lives_in' AS predicate, city AS object_value, CAST(0.82 AS DOUBLE) AS confidence, DATE '2026-03-01' AS valid_from, 'moved-to form' AS notes FROM t WHERE k = 0
UNION ALL SELECT event_id, u, 'lives_in', city, 0.75, NULL, 'lives-in form' FROM t WHERE k IN (1, 4)
UNION ALL SELECT event_id, u, 'stays_in', concat('Hotel', n), 0.68, NULL, 'stay-in form' FROM t WHERE k = 1
UNION ALL SELECT event_id, u, 'stays_in', city, 0.68, NULL, 'the fair' FROM t WHERE k = 2""")
def extract_claims(spark, sf_dir):
    c = X.extract_claims(claim_texts(spark, sf_dir))
    return c.select("event_id", "subject", "predicate", "object_value", F.col("confidence").cast("double").alias("confidence"), "valid_from", "notes")


@query("date_claims", """
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN DATE '2026-03-01' ELSE CAST(ts AS DATE) END AS valid_from FROM events WHERE event_id % 6 IN (0, 1, 2, 4)
UNION ALL SELECT event_id, CAST(ts AS DATE) FROM events WHERE event_id % 6 = 1""")
def date_claims(spark, sf_dir):
    return X.date_claims(X.extract_claims(claim_texts(spark, sf_dir))).select("event_id", "valid_from")


@query("is_question", "SELECT event_id, event_id % 6 IN (3, 5) AS read_only FROM events")
def is_question(spark, sf_dir):
    return claim_texts(spark, sf_dir).select("event_id", X.is_question(F.col("text")).alias("read_only"))


# -- retrieval --------------------------------------------------------------------------

def user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per user about that user's ledger."""
    u = fx.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").cast("date").alias("last_day"))
    return u.select(
        F.col("user_id").alias("question_id"),
        F.concat(F.lit("Which obj_"), (F.col("user_id") % 4).cast("string"), F.lit(" did the clicking happen with, superseded or active? It was reported 2 days ago.")).alias("question"),
        F.date_format("last_day", "yyyy/MM/dd").alias("question_date"), "last_day")


ROW_FIELDS = ["subject", "predicate", "object_value", "status", "valid_from", "source_ref"]


@query("rank_rows", CL.WITH_RUNS + f""", q AS (SELECT user_id AS question_id, CAST(max(ts) AS DATE) - 2 AS target,
    concat('Which obj_', user_id % 4, ' did the clicking happen with, superseded or active? It was reported 2 days ago.') AS question FROM events GROUP BY user_id),
r AS (SELECT user_id AS question_id, version_seq, status, valid_from, concat('subject predicate object value status valid from source ref user_', user_id, ' ', event_type, ' ', object_value, ' ', status, ' ', CAST(valid_from AS VARCHAR), ' ref_', version_seq % 7) AS txt FROM isl),
s AS (SELECT r.question_id, version_seq, len(list_intersect({sql_tokens('q.question')}, {sql_tokens('r.txt')})) + CASE WHEN status = 'active' THEN 0.25 ELSE 0 END + CASE WHEN r.valid_from = q.target THEN 3 ELSE 0 END AS score
      FROM r JOIN q ON q.question_id = r.question_id)
SELECT question_id, version_seq, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, version_seq DESC) AS rn FROM s) WHERE rn <= 5""")
def rank_rows(spark, sf_dir):
    """The five best ledger rows for each user's question; newer versions come first among equals."""
    led = CL.main_ledger(spark, sf_dir)
    d = R.version_detail(led.versions, CL.beliefs(spark, sf_dir), CL.event_sources(spark, sf_dir), fx.branches(spark))
    rows = d.select(F.regexp_extract("subject", "([0-9]+)", 1).cast("long").alias("question_id"), (-F.col("commit_seq")).alias("place"),
                    F.date_format("valid_from", "yyyy-MM-dd").alias("session_date"), "commit_seq", *ROW_FIELDS)
    best = RV.rank_rows(user_questions(spark, sf_dir), rows, ROW_FIELDS, 5)
    return best.select("question_id", F.col("commit_seq").alias("version_seq"), F.col("score").cast("double").alias("score"))


LINES = (
    "I am 34 years old.", "My sister turned 29 last May!", "I sold 12 jars for $ 5 at the market.", "We earned 40 dollars from sales.",
    "I bought two vinyl records.", "I downloaded an album by the band.", "We visited the museum and met a guide.", "I love a hotel with a rooftop pool.",
    "The weather was mild.", "I want a breakfast package near the ocean.", "The order was cancelled on Friday.", "Nothing else to report.",
)


def memory_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short session per event: three known lines, the third on a line of its own."""
    e = fx.table(spark, sf_dir, "events")
    eid = F.col("event_id")
    lines = F.array(*[F.lit(x) for x in LINES])

    def pick(shift: int, step: int):
        return F.element_at(lines, ((eid * step + shift) % len(LINES) + 1).cast("int"))

    return e.select(
        F.col("user_id").alias("question_id"), eid.alias("place"), F.concat(F.lit("ref_"), (eid % 3).cast("string")).alias("source_ref"),
        F.date_format("ts", "yyyy/MM/dd (E) HH:mm").alias("session_date"),
        F.concat(F.lit("[Session x]\n"), pick(0, 1), F.lit("  "), pick(5, 1), F.lit("\n"), pick(3, 7)).alias("excerpt"))


FAMILY_TEXT = ("How old are the family members?", "What is the total amount of money I earned at the market?", "What did I buy 3 days ago?",
               "How many days passed between the museum and the cancelled order?", "How many albums did I get?", "Can you suggest a hotel for the trip?")


def family_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = fx.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").cast("date").alias("last_day"))
    return u.select(F.col("user_id").alias("question_id"),
                    F.element_at(F.array(*[F.lit(t) for t in FAMILY_TEXT]), (F.col("user_id") % 6 + 1).cast("int")).alias("question"),
                    F.date_format("last_day", "yyyy-MM-dd").alias("question_date"))


def memory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.candidate_lines(memory_sources(spark, sf_dir))


_LINE_CTE = "WITH ln AS (SELECT * FROM (VALUES " + ", ".join("(%d, '%s')" % (i, t.replace("'", "''")) for i, t in enumerate(LINES)) + """) AS t(i, line)),
ms AS (SELECT user_id AS question_id, event_id AS place, concat('ref_', event_id % 3) AS source_ref, CAST(ts AS DATE) AS day, event_id FROM events),
al AS (SELECT question_id, place, source_ref, day, 1 AS line_no, event_id % 12 AS i FROM ms UNION ALL SELECT question_id, place, source_ref, day, 2, (event_id + 5) % 12 FROM ms
       UNION ALL SELECT question_id, place, source_ref, day, 3, (event_id * 7 + 3) % 12 FROM ms),
lq AS (SELECT question_id, max(day) - 3 AS target, """ + "CASE question_id % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(FAMILY_TEXT)) + """ END AS question FROM ms GROUP BY question_id),
al2 AS (SELECT al.*, line, target, question FROM al JOIN ln ON ln.i = al.i JOIN lq ON lq.question_id = al.question_id)
"""


def _capped(where: str, cap: int, order: str = "place, line_no") -> str:
    cols = [c.strip() for c in order.split(",")]
    first = f"(SELECT *, row_number() OVER (PARTITION BY question_id, source_ref, i ORDER BY {order}) AS dn FROM al2 WHERE {where})"
    return (_LINE_CTE + f"SELECT question_id, source_ref, line AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {order}) AS rn "
            f"FROM {first} WHERE dn = 1) WHERE rn <= {cap}")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("question_id", "source_ref", "evidence")


@query("evidence_age", _capped("i IN (0, 1)", 20))
def evidence_age(spark, sf_dir):
    return _shown(E.evidence_age(memory_lines(spark, sf_dir), cap=20))


@query("evidence_money", _capped("i IN (2, 3)", 30))
def evidence_money(spark, sf_dir):
    return _shown(E.evidence_money(memory_lines(spark, sf_dir), cap=30))


@query("evidence_relative_date", _capped("question_id % 6 = 2 AND day = target AND (regexp_matches(lower(line), '(bought|downloaded|completed|started)') OR len(list_intersect(" + sql_tokens("question") + ", " + sql_tokens("line") + ")) > 0)", 20))
def evidence_relative_date(spark, sf_dir):
    return _shown(E.evidence_relative_date(memory_lines(spark, sf_dir), family_questions(spark, sf_dir), cap=20))


_COMMON = "list_intersect(" + sql_tokens("question") + ", " + sql_tokens("line") + ")"
_GENERIC = "[" + ", ".join(f"'{t}'" for t in E.GENERIC_TIME) + "]"
_SPECIFIC = f"list_filter({_COMMON}, lambda c: NOT list_contains({_GENERIC}, c))"


@query("evidence_temporal", _LINE_CTE + f""", sc AS (SELECT *, -(2 * len({_SPECIFIC}) + len({_COMMON})) AS rk FROM al2
  WHERE i IN (4, 5, 6, 10) AND (len({_SPECIFIC}) > 0 OR len({_COMMON}) >= 3)),
dd AS (SELECT *, row_number() OVER (PARTITION BY question_id, source_ref, i ORDER BY rk, place, line_no) AS dn FROM sc)
SELECT question_id, source_ref, line AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rk, place, line_no) AS rn FROM dd WHERE dn = 1) WHERE rn <= 20""")
def evidence_temporal(spark, sf_dir):
    return _shown(E.evidence_temporal(memory_lines(spark, sf_dir), family_questions(spark, sf_dir), cap=20))


@query("evidence_count", _capped("CASE WHEN question_id % 6 = 4 THEN i IN (4, 5) ELSE i IN (4, 5, 6, 10) END", 20))
def evidence_count(spark, sf_dir):
    return _shown(E.evidence_count(memory_lines(spark, sf_dir), family_questions(spark, sf_dir), cap=20))


@query("evidence_preference", _capped("question_id % 6 = 5 AND i IN (7, 9)", 20))
def evidence_preference(spark, sf_dir):
    return _shown(E.evidence_preference(memory_lines(spark, sf_dir), family_questions(spark, sf_dir), cap=20))


@query("question_families", """
SELECT user_id AS question_id, CASE user_id % 6 WHEN 0 THEN 'age' WHEN 1 THEN 'money' WHEN 2 THEN 'relative_date' WHEN 3 THEN 'temporal' WHEN 4 THEN 'count' END AS family,
       user_id % 6 = 5 AS preference FROM events GROUP BY user_id""")
def question_families(spark, sf_dir):
    return E.question_families(family_questions(spark, sf_dir))


def memory_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory sources as numbered sessions per question."""
    from claimweave.plans.ordered import numbered
    s = numbered(memory_sources(spark, sf_dir), ["question_id"], ["place"])
    return s.select("question_id", (F.col("position") - 1).alias("session_index"), "session_date", F.col("excerpt").alias("text"), "place")


@query("select_sessions", _LINE_CTE + f""", se AS (SELECT question_id, place, min(day) AS day, any_value(target) AS target, any_value(question) AS question,
    string_agg(line, ' ' ORDER BY line_no) AS txt, bool_or(i = 2) AS jars, bool_or(i = 3) AS earned, bool_or(i IN (4, 5)) AS got FROM al2 GROUP BY question_id, place),
sn AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place) - 1 AS idx, count(*) OVER (PARTITION BY question_id) AS total FROM se),
sx AS (SELECT *, len(list_intersect({sql_tokens('question')}, {sql_tokens("concat('Session x ', txt)")}))
    + CASE WHEN question_id % 6 = 1 THEN CASE WHEN jars OR earned THEN 6.0 ELSE 0 END ELSE 0 END
    + CASE WHEN question_id % 6 = 2 AND day = target THEN 1.5 + CASE WHEN got THEN 3.0 ELSE 0 END ELSE 0 END + 0.05 * idx / total AS score FROM sn)
SELECT question_id, place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, idx DESC) AS rn FROM sx) WHERE rn <= 4""")
def select_sessions(spark, sf_dir):
    return RV.select_sessions(family_questions(spark, sf_dir), memory_sessions(spark, sf_dir), 4).select("question_id", "place")


@query("focus_excerpt")
def focus_excerpt(spark, sf_dir):
    """Every document cut to what it says about a question built from its own words."""
    d = fx.table(spark, sf_dir, "documents")
    question = F.concat_ws(" ", F.slice(F.split(F.col("text"), " "), 3, 4))
    return d.select("doc_id", RV.focus_excerpt(F.col("text"), question, 400, window=900).alias("excerpt"))


@query("focus_session")
def focus_session(spark, sf_dir):
    s = S.session_texts(corpus_turns(spark, sf_dir)).join(corpus(spark, sf_dir).select("question_id", "question"), "question_id")
    header = F.concat(F.lit("[Session "), F.col("session_index").cast("string"), F.lit(" | "), F.coalesce("session_date", F.lit("unknown")), F.lit("]"))
    return s.select("question_id", "session_index", RV.focus_session(F.col("turns"), header, F.col("question"), 800, lines=10, window=900).alias("excerpt"))


@query("retrieve_versions", CL.WITH_RUNS + """
, q AS (SELECT o_orderkey AS question_id, concat('user_', o_custkey % 50) AS t, o_orderkey % 2 = 0 AS history FROM orders),
hit AS (SELECT tt.t, claim_key, version_seq, next_seq, row_number() OVER (PARTITION BY tt.t ORDER BY version_seq DESC, claim_key) AS rn
        FROM (SELECT DISTINCT t FROM q) tt JOIN isl ON contains(concat('user_', user_id, chr(10), event_type, chr(10), object_value), tt.t)),
found AS (SELECT question_id, claim_key, version_seq FROM q JOIN hit ON hit.t = q.t AND rn <= 10 WHERE history OR next_seq IS NULL)
SELECT question_id, claim_key, version_seq FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY version_seq DESC, claim_key) AS k FROM found) WHERE k <= 8""")
def retrieve_versions(spark, sf_dir):
    """One question per order naming a user; every other one asks for history."""
    q = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("question_id"),
        F.concat(F.lit("so User_"), (F.col("o_custkey") % 50).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " why").otherwise("")).alias("question"))
    led = CL.main_ledger(spark, sf_dir)
    d = led.versions.join(CL.beliefs(spark, sf_dir).select("claim_key", "subject", "predicate"), "claim_key", "left")
    found = RV.retrieve_versions(q, d, led.versions.where(R.is_current()), per_term=10, limit=8)
    return found.select("question_id", "claim_key", CL.seq_of("version_id").alias("version_seq"))


@query("context_union", CL.WITH_RUNS + """
, q AS (SELECT DISTINCT user_id AS question_id FROM events),
a AS (SELECT user_id AS question_id, claim_key, version_seq, 0 AS part, row_number() OVER (PARTITION BY user_id ORDER BY version_seq DESC) AS place FROM isl),
b AS (SELECT user_id AS question_id, claim_key, version_seq, 1 AS part, row_number() OVER (PARTITION BY user_id ORDER BY version_seq) AS place FROM isl WHERE next_seq IS NULL),
u AS (SELECT * FROM a WHERE place <= 8 UNION ALL SELECT * FROM b WHERE place <= 30),
d AS (SELECT *, row_number() OVER (PARTITION BY question_id, claim_key, version_seq ORDER BY part, place) AS dn FROM u)
SELECT question_id, claim_key, version_seq, row_number() OVER (PARTITION BY question_id ORDER BY part, place) AS position FROM d WHERE dn = 1
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY part, place) <= 10""")
def context_union(spark, sf_dir):
    from pyspark.sql import Window as W
    v = CL.main_ledger(spark, sf_dir).versions.withColumn("question_id", F.regexp_extract("claim_key", "([0-9]+)", 1).cast("long"))

    def top(rows: DataFrame, order, k: int) -> DataFrame:
        place = F.row_number().over(W.partitionBy("question_id").orderBy(order))
        return rows.select("question_id", *R.KEY, place.alias("place")).where(F.col("place") <= k)

    both = R.context_union(top(v, F.col("version_id").desc(), 8), top(v.where(R.is_current()), F.col("version_id"), 30), 10)
    return both.select("question_id", "claim_key", CL.seq_of("version_id").alias("version_seq"), F.col("position").cast("long").alias("position"))


@query("source_rows_union", f"""
WITH s AS (SELECT CASE WHEN doc_id % 3 = 0 THEN {sql_canonical('text')} ELSE source END AS k, 0 AS part, doc_id AS id FROM documents
  UNION ALL SELECT concat('session-', conv_id), 1, conv_id FROM conversations GROUP BY conv_id
  UNION ALL SELECT source, 1, 10000000 + min(doc_id) FROM documents GROUP BY source)
SELECT k AS source_key, arg_min(part, (part, id)) AS part, arg_min(id, (part, id)) AS id FROM s GROUP BY k""")
def source_rows_union(spark, sf_dir):
    """Stored sources, then sessions, first row per reference (per text where there is none)."""
    from claimweave.functions.text import canonical_text
    d, c = fx.table(spark, sf_dir, "documents"), fx.table(spark, sf_dir, "conversations")
    stored = d.select(F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("ref"), F.col("text"), F.lit(0).alias("part"), F.col("doc_id").alias("id"))
    sessions = c.select(F.concat(F.lit("session-"), "conv_id").alias("ref"), F.lit("").alias("text"), F.lit(1).alias("part"), F.col("conv_id").alias("id")).distinct()
    again = d.groupBy("source").agg(F.min("doc_id").alias("m")).select(F.col("source").alias("ref"), F.lit("").alias("text"), F.lit(1).alias("part"), (F.col("m") + 10000000).alias("id"))
    rows = stored.unionByName(sessions).unionByName(again).withColumn("source_key", F.coalesce("ref", canonical_text(F.col("text"))))
    return rows.groupBy("source_key").agg(F.min(F.struct("part", "id")).alias("f")).select("source_key", "f.part", "f.id")


# -- reductions ---------------------------------------------------------------------------

def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence candidates per user with amounts, dates and roles."""
    e = fx.table(spark, sf_dir, "events")
    eid = F.col("event_id")
    role = F.element_at(F.array(*[F.lit(r) for r in ("target", "supporting", "distractor", "target", "anchor")]), (eid % 5 + 1).cast("int"))
    return e.select(
        F.col("user_id").alias("question_id"), eid.alias("place"), role.alias("role"),
        F.when(eid % 3 == 0, F.col("value")).alias("amount"), F.when(eid % 3 == 1, (eid % 7).cast("double")).alias("quantity"),
        F.when(eid % 3 == 1, F.lit(2.5)).alias("unit_price"),
        F.when(eid % 4 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("event_date"), F.when(eid % 4 == 0, F.when(eid % 8 == 0, F.date_format("ts", "yyyy/MM/dd"))).alias("session_date"),
        F.when(eid % 2 == 0, F.concat(F.lit("Event "), (eid % 11).cast("string"), F.lit("!"))).alias("event_name"),
        F.concat(F.lit("thing "), (eid % 13).cast("string")).alias("object_value"), F.lit("seen").alias("evidence"))


_CAND_CTE = """WITH k AS (SELECT user_id AS question_id, event_id AS place, list_extract(['target', 'supporting', 'distractor', 'target', 'anchor'], CAST(event_id % 5 + 1 AS INT)) AS role,
  CASE event_id % 3 WHEN 0 THEN CAST(value AS DECIMAL(18,4)) WHEN 1 THEN CAST(event_id % 7 * 2.5 AS DECIMAL(18,4)) END AS amount,
  CASE WHEN event_id % 4 <> 0 OR event_id % 8 = 0 THEN CAST(ts AS DATE) END AS day,
  CASE WHEN event_id % 2 = 0 THEN concat('Event ', event_id % 11, '!') END AS event_name,
  CASE WHEN event_id % 2 = 0 THEN concat('event ', event_id % 11) ELSE concat('thing ', event_id % 13) END AS label FROM events)
"""


@query("reduce_sum", _CAND_CTE + "SELECT question_id, count(*) AS n_addends, CAST(sum(amount) AS DOUBLE) AS total FROM k WHERE role <> 'distractor' AND amount IS NOT NULL GROUP BY question_id")
def reduce_sum(spark, sf_dir):
    return E.reduce_sum(candidates(spark, sf_dir))


@query("reduce_order", _CAND_CTE + """
SELECT question_id, count(*) AS n_dated, arg_min_null(event_name, (day, place)) AS earliest, min(day) AS earliest_date FROM k WHERE role <> 'distractor' AND day IS NOT NULL GROUP BY question_id""")
def reduce_order(spark, sf_dir):
    return E.reduce_order(candidates(spark, sf_dir))


@query("reduce_duration", _CAND_CTE + """
SELECT question_id, min(day) AS start_date, max(day) AS end_date, max(day) - min(day) AS elapsed_days, round((max(day) - min(day)) / 7, 4) AS elapsed_weeks
FROM k WHERE role <> 'distractor' AND day IS NOT NULL GROUP BY question_id HAVING count(*) >= 2""")
def reduce_duration(spark, sf_dir):
    return E.reduce_duration(candidates(spark, sf_dir)).withColumn("elapsed_days", F.col("elapsed_days").cast("long"))


@query("reduce_count_bounded", _CAND_CTE + """
, a AS (SELECT question_id, min(day) AS anchor_date FROM k WHERE role = 'anchor' GROUP BY question_id)
SELECT k.question_id, max(anchor_date) AS anchor_date, count(DISTINCT label) AS n FROM k LEFT JOIN a ON a.question_id = k.question_id
WHERE role = 'target' AND (anchor_date IS NULL OR day IS NULL OR CASE WHEN k.question_id % 2 = 0 THEN day < anchor_date ELSE day > anchor_date END) GROUP BY k.question_id""")
def reduce_count_bounded(spark, sf_dir):
    c = candidates(spark, sf_dir)
    rel = c.select("question_id").distinct().withColumn("temporal_relation", F.when(F.col("question_id") % 2 == 0, "Before the anchor").otherwise("after"))
    return E.reduce_count_bounded(c, rel)


@query("reduce_filter_date", _CAND_CTE + """
, q AS (SELECT user_id AS question_id, CAST(max(ts) AS DATE) - 3 AS target FROM events GROUP BY user_id)
SELECT k.question_id, place, day FROM k JOIN q ON q.question_id = k.question_id AND k.day = q.target WHERE role <> 'distractor' AND k.question_id % 6 = 2""")
def reduce_filter_date(spark, sf_dir):
    return E.reduce_filter_date(candidates(spark, sf_dir), family_questions(spark, sf_dir)).select("question_id", "place", "day")
