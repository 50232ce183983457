"""Flat memories, answers, scoring and evaluation-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimweave.functions.scores import as_score
from claimweave.operators import evaluate as V, flat as FL, ledger as L, reads as R
from claimweave.plans import catalog_checks as CC, catalog_ledger as CL, fixtures as fx
from claimweave.plans.registry import query
from claimweave.sources.corpus import QUESTION_TYPES


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event claims as flat facts with the text a retriever indexes."""
    c = fx.event_claims(spark, sf_dir)
    ref = F.concat(F.lit("ref_"), (F.col("seq") % 7).cast("string"))
    doc = F.concat("subject", F.lit(" "), "predicate", F.lit(" "), "object_value", F.lit(". Source "), ref, F.lit(". Branch main. Record "), F.col("seq").cast("string"))
    return c.select(F.col("seq").alias("fact_id"), "subject", "predicate", "object_value", ref.alias("source_ref"), "trust_score", "confidence",
                    "valid_from", F.lit("main").alias("branch_name"), doc.alias("document"))


def key_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per (user, event type), numbered by the first event; every third prompt does not name the user."""
    c = fx.event_claims(spark, sf_dir)
    q = c.groupBy("subject", "predicate").agg(F.min("seq").alias("question_id"))
    prompt = F.when(F.col("question_id") % 3 == 0, F.concat(F.lit("What was the latest "), "predicate", F.lit("?"))).otherwise(
        F.concat(F.lit("What does "), F.upper("subject"), F.lit(" have for "), "predicate", F.lit("?")))
    return q.select("question_id", prompt.alias("prompt"), "subject", "predicate", F.lit("main").alias("branch_name"),
                    F.concat_ws(" ", F.lower(prompt), "subject", "predicate", F.lit("main")).alias("query"))


FACTS_CTE = "WITH " + CL.CLAIMS_CTE + """,
fa AS (SELECT seq AS fact_id, user_id, concat('user_', user_id) AS subject, event_type AS predicate, object_value, concat('ref_', seq % 7) AS source_ref, trust_score, confidence, valid_from,
              lower(concat('user_', user_id, ' ', event_type, ' ', object_value, '. Source ref_', seq % 7, '. Branch main. Record ', seq)) AS document FROM c),
q0 AS (SELECT min(fact_id) AS question_id, subject, predicate FROM fa GROUP BY subject, predicate),
q AS (SELECT *, lower(CASE WHEN question_id % 3 = 0 THEN concat('What was the latest ', predicate, '?') ELSE concat('What does ', upper(subject), ' have for ', predicate, '?') END) AS prompt FROM q0)
"""


@query("chat_history", FACTS_CTE + """
SELECT question_id, arg_max(object_value, fact_id) AS object_value, arg_max(source_ref, fact_id) AS source_ref, count(*) AS n_history
FROM q JOIN fa ON fa.subject = q.subject AND fa.predicate = q.predicate GROUP BY question_id""")
def chat_history(spark, sf_dir):
    return FL.chat_history(facts(spark, sf_dir), key_questions(spark, sf_dir))


_TRUST = """, b AS (SELECT subject, predicate, arg_max(fact_id, (trust_score, fact_id)) AS fact_id, max(trust_score) AS t FROM fa GROUP BY subject, predicate),
m AS (SELECT q.question_id, arg_max(b.fact_id, (t, b.fact_id)) AS fact_id FROM q JOIN b ON b.predicate = q.predicate AND contains(q.prompt, lower(b.subject)) GROUP BY q.question_id),
tr AS (SELECT q.question_id, coalesce(m.fact_id, b.fact_id) AS fact_id FROM q LEFT JOIN m ON m.question_id = q.question_id JOIN b ON b.subject = q.subject AND b.predicate = q.predicate)
"""


@query("trust_retrieval", FACTS_CTE + _TRUST + "SELECT question_id, fa.fact_id, object_value, source_ref FROM tr JOIN fa ON fa.fact_id = tr.fact_id")
def trust_retrieval(spark, sf_dir):
    return FL.trust_retrieval(facts(spark, sf_dir), key_questions(spark, sf_dir))


@query("flat_support", FACTS_CTE + _TRUST + """
SELECT DISTINCT question_id, o.source_ref FROM tr JOIN fa ON fa.fact_id = tr.fact_id JOIN fa o ON o.subject = fa.subject AND o.predicate = fa.predicate AND o.object_value = fa.object_value""")
def flat_support(spark, sf_dir):
    f = facts(spark, sf_dir)
    return FL.flat_support(f, FL.trust_retrieval(f, key_questions(spark, sf_dir)))


_TFIDF = """, dt AS (SELECT fact_id, term, count(*) AS tf FROM (SELECT fact_id, unnest(regexp_extract_all(document, '[a-z0-9]+')) AS term FROM fa) GROUP BY fact_id, term),
nd AS (SELECT count(*) AS n FROM fa), idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1.0 AS idf FROM dt, nd GROUP BY term, n),
dw AS (SELECT fact_id, dt.term, tf * idf AS w FROM dt JOIN idf ON idf.term = dt.term), dn AS (SELECT fact_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY fact_id),
qt AS (SELECT question_id, term, count(*) AS tf FROM (SELECT question_id, unnest(regexp_extract_all(concat_ws(' ', prompt, subject, predicate, 'main'), '[a-z0-9]+')) AS term FROM q) GROUP BY question_id, term),
qv AS (SELECT question_id, qt.term, tf * coalesce(idf, ln(1 + n) + 1.0) AS w FROM qt LEFT JOIN idf ON idf.term = qt.term, nd), qn AS (SELECT question_id, sqrt(sum(w * w)) AS norm FROM qv GROUP BY question_id),
sc AS (SELECT qv.question_id, dw.fact_id, round(sum(qv.w / qn.norm * (dw.w / dn.norm)), 9) AS score FROM qv JOIN qn ON qn.question_id = qv.question_id JOIN dw ON dw.term = qv.term JOIN dn ON dn.fact_id = dw.fact_id GROUP BY qv.question_id, dw.fact_id),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, fact_id) AS rank FROM sc) WHERE rank <= 5)
"""


@query("tfidf_topk", FACTS_CTE + _TFIDF + "SELECT question_id, fact_id, score, rank FROM tk")
def tfidf_topk(spark, sf_dir):
    t = FL.tfidf_topk(facts(spark, sf_dir), key_questions(spark, sf_dir), 5)
    return t.select("question_id", "fact_id", "score", F.col("rank").cast("long").alias("rank"))


@query("tfidf_answer", FACTS_CTE + _TFIDF + """, nr AS (SELECT q.question_id, arg_max(fa.fact_id, (valid_from, trust_score * confidence, fa.fact_id)) AS fact_id FROM tk JOIN q ON q.question_id = tk.question_id JOIN fa ON fa.fact_id = tk.fact_id AND fa.subject = q.subject AND fa.predicate = q.predicate GROUP BY q.question_id),
ow AS (SELECT q.question_id, arg_max(fa.fact_id, (valid_from, trust_score * confidence, fa.fact_id)) AS fact_id FROM q JOIN fa ON fa.subject = q.subject AND fa.predicate = q.predicate GROUP BY q.question_id)
SELECT ow.question_id, fa.fact_id, fa.object_value, fa.source_ref FROM ow LEFT JOIN nr ON nr.question_id = ow.question_id JOIN fa ON fa.fact_id = coalesce(nr.fact_id, ow.fact_id)""")
def tfidf_answer(spark, sf_dir):
    f, q = facts(spark, sf_dir), key_questions(spark, sf_dir)
    return FL.tfidf_answer(f, q, FL.tfidf_topk(f, q, 5))


_DOC_TFIDF = (_TFIDF.replace("FROM fa)", "FROM dd)").replace("count(*) AS n FROM fa", "count(*) AS n FROM dd").replace("concat_ws(' ', prompt, subject, predicate, 'main')", "text").replace("AS term FROM q)", "AS term FROM dq)"))


@query("tfidf_documents", """WITH dd AS (SELECT doc_id AS fact_id, lower(text) AS document FROM documents), dq AS (SELECT item_id AS question_id, lower(text) AS text FROM benchmark)""" + _DOC_TFIDF + """
SELECT question_id, fact_id, score, rank FROM tk""")
def tfidf_documents(spark, sf_dir):
    """The documents nearest to each benchmark item."""
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fact_id"), F.col("text").alias("document"))
    asked = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.lower("text").alias("query"))
    return FL.tfidf_topk(docs, asked, 5).select("question_id", "fact_id", "score", F.col("rank").cast("long").alias("rank"))


@query("low_trust_warning", "SELECT event_id AS question_id, event_id % 2 = 0 AND event_id % 20 + 1 < 7 AS had_low_trust_warning FROM events")
def low_trust_warning(spark, sf_dir):
    f = facts(spark, sf_dir)
    related = f.select(F.col("fact_id").alias("question_id"), F.when(F.col("fact_id") % 2 == 0, F.col("fact_id")).alias("fact_id"))
    return FL.low_trust_warning(f, related)


@query("ledger_answers", CL.WITH_RUNS + """
, b AS (SELECT claim_key, vno, arg_max(seq, (trust_score, seq)) AS src FROM g GROUP BY claim_key, vno), fq AS (SELECT claim_key, min(seq) AS question_id FROM c GROUP BY claim_key)
SELECT question_id, object_value, object_value AS answer_text, concat('ref_', src % 7) AS source_ref, n_versions AS n_history, false AS unresolved_conflict, true AS conflict_resolved
FROM isl JOIN b ON b.claim_key = isl.claim_key AND b.vno = isl.vno JOIN fq ON fq.claim_key = isl.claim_key WHERE next_seq IS NULL""")
def ledger_answers(spark, sf_dir):
    led = CL.main_ledger(spark, sf_dir)
    visible = CL.visible_main(spark, sf_dir)
    chosen = R.choose_current(visible)
    prov = R.exact_provenance(chosen, led.direct, CL.event_sources(spark, sf_dir), fx.branches(spark))
    asked = CL.beliefs(spark, sf_dir).select(F.col("first_seq").alias("question_id"), F.lit(1).cast("long").alias("viewer_id"), "claim_key")
    return FL.ledger_answers(asked, chosen, prov, visible, led.versions)


@query("ablations", CL.WITH_RUNS + """
SELECT 'no_branches' AS ablation, (SELECT count(*) FROM isl) AS n_versions, (SELECT count(*) FROM isl WHERE next_seq IS NULL) AS n_active
UNION ALL SELECT 'no_rollback', (SELECT count(*) FROM isl), (SELECT count(*) FROM isl WHERE next_seq IS NULL)
UNION ALL SELECT 'no_trust_scoring', (SELECT count(*) FROM isl), (SELECT count(*) FROM isl WHERE next_seq IS NULL)
UNION ALL SELECT 'full', (SELECT count(*) FROM isl), (SELECT count(*) FROM isl WHERE vno = n_versions - 1)""")
def ablations(spark, sf_dir):
    """Versions and active versions with a mechanism switched off; 'full' has every last commit rolled back."""
    claims, undo, b = CL.main_claims(spark, sf_dir), CL.rollbacks(spark, sf_dir), fx.branches(spark)
    runs = {"no_branches": (CL.branch_claims(spark, sf_dir), None), "no_rollback": (claims, undo), "no_trust_scoring": (claims, None)}
    out = None
    for name, (c, ctl) in runs.items():
        versions = L.versions_table(L.fold_events(*_three(FL.ablated_inputs(name, c, ctl), b)))
        row = versions.agg(F.count("*").alias("n_versions"), F.count(F.when(R.is_current(), 1)).alias("n_active")).select(F.lit(name).alias("ablation"), "n_versions", "n_active")
        out = row if out is None else out.unionByName(row)
    full = CL.rollback_ledger(spark, sf_dir).versions
    return out.unionByName(full.agg(F.count("*").alias("n_versions"), F.count(F.when(R.is_current(), 1)).alias("n_active")).select(F.lit("full").alias("ablation"), "n_versions", "n_active"))


def _three(inputs, branches):
    claims, control = inputs
    return claims, branches, control


@query("context_reader", CL.WITH_RUNS + """
SELECT user_id AS question_id, arg_max(claim_key, (status = 'active', event_type = 'click', version_seq)) AS claim_key, arg_max(object_value, (status = 'active', event_type = 'click', version_seq)) AS object_value
FROM isl GROUP BY user_id""")
def context_reader(spark, sf_dir):
    """Each user's ledger shown twice (current part, timeline part), asked about clicks."""
    led = CL.main_ledger(spark, sf_dir)
    d = R.version_detail(led.versions, CL.beliefs(spark, sf_dir), CL.event_sources(spark, sf_dir), fx.branches(spark))
    rows = d.select(F.regexp_extract("subject", "([0-9]+)", 1).cast("long").alias("question_id"), F.col("commit_seq").alias("place"),
                    F.col("version_id").alias("row_id"), "subject", "predicate", "branch_name", "status", "object_value", "source_ref", "claim_key")
    context = rows.where(R.is_current()).withColumn("part", F.lit(0)).unionByName(rows.withColumn("part", F.lit(1))).drop("claim_key")
    q = rows.select("question_id", "subject").distinct().select("question_id", "subject", F.lit("click").alias("predicate"), F.lit("main").alias("branch_name"))
    answers = FL.context_reader(context, q)
    return answers.join(rows.select("question_id", "row_id", "claim_key"), ["question_id", "row_id"]).select("question_id", "claim_key", "object_value")


_ASKED = ("click", "error", "purchase", "signup", "view")


@query("question_context", CC._RUN_ORACLE + """
, us AS (SELECT DISTINCT user_id, ['click', 'error', 'purchase', 'signup', 'view'][CAST(user_id % 5 + 1 AS INT)] AS asked FROM c),
v1 AS (SELECT isl.*, row_number() OVER (PARTITION BY isl.user_id ORDER BY version_seq DESC) AS nth,
         CASE WHEN status = 'active' THEN row_number() OVER (PARTITION BY isl.user_id, status ORDER BY isl.event_type = us.asked DESC, version_seq DESC) END AS best FROM isl JOIN us ON us.user_id = isl.user_id),
vs AS (SELECT user_id, count(*) AS version_count, string_agg(concat(claim_key, '=', object_value), ';' ORDER BY best) FILTER (WHERE best <= 3) AS current,
         string_agg(concat(claim_key, '=', object_value), ';' ORDER BY nth) FILTER (WHERE nth <= 8) AS timeline FROM v1 GROUP BY user_id),
s1 AS (SELECT w.user_id, dec.staged_id, dec.status, row_number() OVER (PARTITION BY w.user_id ORDER BY dec.staged_id DESC) AS nth FROM dec JOIN w ON w.staged_id = dec.staged_id),
ss AS (SELECT user_id, count(*) AS staged_count, string_agg(concat(staged_id, '=', status), ';' ORDER BY nth) FILTER (WHERE nth <= 5) AS staged FROM s1 GROUP BY user_id),
a1 AS (SELECT version_seq AS seq, 'belief_version.created' AS event_type, claim_key FROM isl UNION ALL SELECT seq, 'belief_source.support_added', claim_key FROM c
  UNION ALL SELECT min(seq), 'belief.created', claim_key FROM c GROUP BY claim_key),
a2 AS (SELECT a1.*, c.user_id, row_number() OVER (PARTITION BY c.user_id ORDER BY a1.seq DESC, a1.event_type, a1.claim_key) AS nth FROM a1 JOIN c ON c.seq = a1.seq),
aa AS (SELECT user_id, count(*) AS audit_count, string_agg(concat(seq, '=', event_type), ';' ORDER BY nth) FILTER (WHERE nth <= 6) AS audit FROM a2 GROUP BY user_id)
SELECT us.user_id AS question_id, current, timeline, staged, audit, version_count, staged_count, audit_count FROM us JOIN vs ON vs.user_id = us.user_id JOIN ss ON ss.user_id = us.user_id JOIN aa ON aa.user_id = us.user_id""")
def question_context(spark, sf_dir):
    """A question per user, asked of what is known about that user."""
    led = CL.main_ledger(spark, sf_dir)
    user = lambda key: F.regexp_extract(key, "user_([0-9]+)", 1).cast("long").alias("question_id")
    e = fx.table(spark, sf_dir, "events")
    asked = F.element_at(F.array(*[F.lit(a) for a in _ASKED]), (F.col("user_id") % 5 + 1).cast("int"))
    questions = e.select(F.col("user_id").alias("question_id"), F.concat(F.lit("What is the "), asked, F.lit(" of user_"), F.col("user_id"), F.lit("?")).alias("question")).distinct()
    versions = led.versions.select(user("claim_key"), "claim_key", "version_id", "object_value", "status", F.concat_ws(" ", F.split("claim_key", "::"), "object_value").alias("text"))
    writes = CC.checked(spark, sf_dir)[0].join(e.select(F.col("event_id").alias("staged_id"), F.col("user_id").alias("question_id")), "staged_id").select("question_id", "staged_id", "status")
    log = R.audit_log(led.events, CL.main_claims(spark, sf_dir).select("seq").distinct(), CL.beliefs(spark, sf_dir))
    log = log.where(F.col("event_type").isin("belief_version.created", "belief_source.support_added", "belief.created")).select(user("entity_key"), "seq", "event_type", "entity_key")
    rows = FL.question_context(questions, versions, writes, log, currents=3, timelines=8, proposals=5, events=6)
    told = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat(x[a].cast("string"), F.lit("="), x[b])), ";").alias(c)
    return rows.select("question_id", told("current", "claim_key", "object_value"), told("timeline", "claim_key", "object_value"), told("staged", "staged_id", "status"),
                       told("audit", "seq", "event_type"), "version_count", "staged_count", "audit_count")


@query("answer_context")
def answer_context(spark, sf_dir):
    led = CL.main_ledger(spark, sf_dir)
    commits = CL.main_claims(spark, sf_dir).select("seq").distinct()
    audit = R.audit_log(led.events, commits, CL.beliefs(spark, sf_dir))
    visible = R.current_versions(led.versions, fx.branches(spark), spark.sql("SELECT CAST(1 AS BIGINT) AS branch_id"))  # nothing of it is scored
    return FL.answer_context(visible, led.versions, CC.checked(spark, sf_dir)[0], audit, timelines=80, proposals=30, events=40)


# -- scoring -----------------------------------------------------------------------------

METRICS = ("current_truth_accuracy", "historical_truth_accuracy", "provenance_accuracy", "rollback_recovery_rate", "branch_isolation_score",
           "merge_conflict_resolution_score", "low_trust_warning_rate", "support_set_accuracy")
_METRIC_LIST = "[" + ", ".join(f"'{m}'" for m in METRICS) + "]"
_SCORE_CTE = f"""WITH x AS (SELECT event_id AS i, list_extract({_METRIC_LIST}, CAST(event_id % 8 + 1 AS INT)) AS metric,
  event_id % 3 = 0 AS right_object, event_id % 11 = 0 AS names_forbidden, event_id % 5 < 3 AS same_history, event_id % 4 <> 1 AS same_ref, event_id % 7 = 0 AS open_expected,
  event_id % 2 = 0 AS open_seen, event_id % 5 = 0 AS warned, event_id % 6 < 2 AS expect_warn, event_id % 9 < 5 AS same_support FROM events),
y AS (SELECT *, right_object AND NOT names_forbidden AS match FROM x),
z AS (SELECT *, CASE metric WHEN 'historical_truth_accuracy' THEN same_history WHEN 'provenance_accuracy' THEN same_ref
  WHEN 'merge_conflict_resolution_score' THEN CASE WHEN open_expected THEN open_seen ELSE match AND NOT open_seen END
  WHEN 'low_trust_warning_rate' THEN warned = expect_warn WHEN 'support_set_accuracy' THEN match AND same_support ELSE match END AS ok FROM y)
"""


def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    i = F.col("event_id")
    right = i % 3 == 0
    questions = e.select(
        i.alias("question_id"), F.element_at(F.array(*[F.lit(m) for m in METRICS]), (i % 8 + 1).cast("int")).alias("metric"),
        F.lit("Busan").alias("expected_object_value"), F.when(i % 11 == 0, "Mars").alias("forbidden_object_value"),
        F.array(F.lit("Seoul"), F.lit("Busan")).alias("expected_historical_objects"), F.lit(None).cast("date").alias("as_of"),
        F.lit("ref_a").alias("expected_source_ref"), F.array(F.lit("ref_b"), F.lit("ref_a")).alias("expected_support_source_refs"),
        (i % 7 == 0).alias("expected_unresolved_conflict"), (i % 6 < 2).alias("expected_low_trust_warning"))
    answers = e.select(
        i.alias("question_id"), F.lit("system").alias("system_name"), F.when(right, "BUSAN").otherwise("Seoul").alias("object_value"),
        F.when(i % 11 == 0, "moved to mars").otherwise("as said").alias("answer_text"),
        F.when(i % 5 < 3, F.array(F.lit("seoul"), F.lit("busan"))).otherwise(F.array(F.lit("busan"), F.lit("seoul"))).alias("historical_objects"),
        F.when(i % 4 != 1, "ref_a").alias("source_ref"),
        F.when(i % 9 < 5, F.array(F.lit("REF_A"), F.lit("ref_b"), F.lit("ref_a"))).otherwise(F.array(F.lit("ref_a"))).alias("support_source_refs"),
        (i % 5 == 0).alias("had_low_trust_warning"), (i % 2 == 0).alias("unresolved_conflict"), (i % 2 != 0).alias("conflict_resolved"))
    return V.score_answers(questions, answers)


@query("score_answers", _SCORE_CTE + """
SELECT i AS question_id, metric, CAST(ok AS DOUBLE) AS score,
  CASE metric WHEN 'historical_truth_accuracy' THEN 'Seoul -> Busan' WHEN 'provenance_accuracy' THEN 'ref_a' WHEN 'support_set_accuracy' THEN 'ref_a, ref_b'
    WHEN 'merge_conflict_resolution_score' THEN CASE WHEN open_expected THEN 'unresolved_conflict' ELSE 'Busan' END ELSE 'Busan' END AS expected FROM z""")
def score_answers(spark, sf_dir):
    return scored_answers(spark, sf_dir).select("question_id", "metric", "score", "expected")


@query("metric_summary", _SCORE_CTE + "SELECT 'system' AS system_name, metric, avg(CAST(ok AS DOUBLE)) AS score, CAST(count(*) AS DOUBLE) AS n FROM z GROUP BY metric")
def metric_summary(spark, sf_dir):
    return V.metric_summary(scored_answers(spark, sf_dir))


@query("history_matches", CL.WITH_RUNS + "SELECT claim_key AS question_id, max(user_id) % 4 <> 0 AND (max(user_id) % 4 <> 1 OR count(*) = 1) AS matches FROM isl GROUP BY claim_key")
def history_matches(spark, sf_dir):
    """Each key's history against an expectation that has one entry too many (every 4th user) or its first entry wrong (the next)."""
    h = R.belief_timeline(CL.main_ledger(spark, sf_dir).versions).withColumn("question_id", F.col("claim_key")).withColumn(
        "u", F.regexp_extract("claim_key", "([0-9]+)", 1).cast("long") % 4)
    last = h.groupBy("question_id", "u").agg(F.max("position").alias("n"))
    longer = last.where("u = 0").select("question_id", (F.col("n") + 1).alias("position"), F.lit("more").alias("object_value"))
    first_wrong = F.when((F.col("u") == 1) & (F.col("position") == 1) & (F.col("n") > 1), "wrong").otherwise(F.upper("object_value"))
    expected = h.join(last.select("question_id", "n"), "question_id").select("question_id", "position", first_wrong.alias("object_value"))
    return V.history_matches(expected.unionByName(longer), h.select("question_id", "position", "object_value"))


def eval_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records from documents, log rows from labels in three shards with repeats and strangers."""
    d, l = fx.table(spark, sf_dir, "documents"), fx.table(spark, sf_dir, "labels")
    qid = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 0, "_abs").otherwise(""))
    records = d.select(qid.alias("question_id"), F.element_at(F.array(*[F.lit(t) for t in QUESTION_TYPES]), (F.col("doc_id") % 5 + 1).cast("int")).alias("question_type"))
    rows = l.select(qid.alias("question_id"), (F.col("doc_id") % 3).cast("int").alias("shard"), F.col("doc_id").alias("row_no"), (F.col("quality") == 1).alias("label"), "doc_id")
    again = rows.where("doc_id % 10 = 0").withColumn("shard", F.col("shard") + 1).withColumn("label", ~F.col("label"))
    strange = rows.where("doc_id % 25 = 0").withColumn("question_id", F.concat(F.lit("x"), "question_id"))
    return records, rows.unionByName(again).unionByName(strange).drop("doc_id")


_EVAL_CTE = "WITH ty AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(QUESTION_TYPES)) + """) AS t(i, question_type)),
r AS (SELECT concat('d', doc_id, CASE WHEN doc_id % 9 = 0 THEN '_abs' ELSE '' END) AS question_id, question_type, doc_id FROM documents JOIN ty ON ty.i = doc_id % 5),
lg AS (SELECT doc_id, concat('d', doc_id, CASE WHEN doc_id % 9 = 0 THEN '_abs' ELSE '' END) AS question_id, doc_id % 3 AS shard, quality = 1 AS label FROM labels),
a AS (SELECT * FROM lg UNION ALL SELECT doc_id, question_id, shard + 1, NOT label FROM lg WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, concat('x', question_id), shard, label FROM lg WHERE doc_id % 25 = 0)
"""


@query("eval_summary", _EVAL_CTE + """
, f AS (SELECT lg.*, question_type, CAST(label AS DOUBLE) AS v FROM lg JOIN r ON r.question_id = lg.question_id),
t AS (SELECT ty.question_type, round(coalesce(avg(v), 0), 4) AS accuracy, count(v) AS n FROM ty LEFT JOIN f ON f.question_type = ty.question_type GROUP BY ty.question_type)
SELECT concat('task:', question_type) AS item, accuracy, n FROM t UNION ALL SELECT 'overall', round(avg(v), 4), count(*) FROM f
UNION ALL SELECT 'task_averaged', round(avg(accuracy), 4), count(*) FROM t WHERE n > 0 UNION ALL SELECT 'abstention', round(avg(v), 4), count(*) FROM f WHERE doc_id % 9 = 0""")
def eval_summary(spark, sf_dir):
    """Summary of the combined log: first row per id."""
    records, logs = eval_inputs(spark, sf_dir)
    return V.eval_summary(records, V.first_log_rows(records, logs))


@query("shard_coverage", _EVAL_CTE + """
SELECT 'expected' AS kind, count(*) AS n FROM r UNION ALL SELECT 'observed', count(*) FROM lg UNION ALL SELECT 'missing', count(*) FROM r WHERE doc_id NOT IN (SELECT doc_id FROM lg)
UNION ALL SELECT 'duplicate', count(*) FROM lg WHERE doc_id % 10 = 0 UNION ALL SELECT 'unexpected', count(*) FROM lg WHERE doc_id % 25 = 0""")
def shard_coverage(spark, sf_dir):
    records, logs = eval_inputs(spark, sf_dir)
    return V.shard_coverage(records, logs, allow_incomplete=True)


@query("id_coverage", _EVAL_CTE + """
SELECT 'missing' AS kind, question_id, CAST(1 AS BIGINT) AS n FROM r WHERE doc_id NOT IN (SELECT doc_id FROM lg) UNION ALL SELECT 'duplicate', question_id, 1 FROM lg WHERE doc_id % 10 = 0
UNION ALL SELECT 'unexpected', concat('x', question_id), 1 FROM lg WHERE doc_id % 25 = 0""")
def id_coverage(spark, sf_dir):
    return V.id_coverage(*eval_inputs(spark, sf_dir))


def governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate outcomes of the staged writes against an expectation by source trust."""
    w = CC.checked(spark, sf_dir)[0]
    expected = F.when(F.col("trust_score") < F.lit("0.35").cast("decimal(6,4)"), "quarantine").when(F.col("staged_id") % 3 == 0, "require_review").otherwise("auto_apply")
    observed = F.when(F.col("status") == "checked", "applied").otherwise(F.col("status"))
    decision = F.when(F.col("status") == "checked", "auto_apply").when(F.col("status") == "quarantined", "quarantine").when(F.col("status") == "review_required", "require_review").otherwise("reject")
    return w.select("staged_id", expected.alias("expected_decision"), observed.alias("observed_status"), decision.alias("observed_decision"), (F.col("staged_id") % 7 == 0).alias("unsafe"))


_GOV_CTE = CC._RUN_ORACLE + """, gv AS (SELECT dec.staged_id, CASE WHEN trust < 0.35 THEN 'quarantine' WHEN dec.staged_id % 3 = 0 THEN 'require_review' ELSE 'auto_apply' END AS e,
  CASE WHEN status = 'checked' THEN 'applied' ELSE status END AS o, dec.staged_id % 7 = 0 AS unsafe FROM dec JOIN w ON w.staged_id = dec.staged_id)
"""


@query("governance_metrics", _GOV_CTE + """
SELECT 'quarantine_precision' AS metric, coalesce(round(count(*) FILTER (WHERE o = 'quarantined' AND e = 'quarantine') / nullif(count(*) FILTER (WHERE o = 'quarantined'), 0), 4), 1.0) AS score, CAST(count(*) FILTER (WHERE o = 'quarantined') AS DOUBLE) AS n FROM gv
UNION ALL SELECT 'quarantine_recall', coalesce(round(count(*) FILTER (WHERE o = 'quarantined' AND e = 'quarantine') / nullif(count(*) FILTER (WHERE e = 'quarantine'), 0), 4), 1.0), CAST(count(*) FILTER (WHERE e = 'quarantine') AS DOUBLE) FROM gv
UNION ALL SELECT 'unsafe_commit_block_rate', coalesce(round(count(*) FILTER (WHERE unsafe AND o <> 'applied') / nullif(count(*) FILTER (WHERE unsafe), 0), 4), 1.0), CAST(count(*) FILTER (WHERE unsafe) AS DOUBLE) FROM gv
UNION ALL SELECT 'benign_commit_pass_rate', coalesce(round(count(*) FILTER (WHERE e = 'auto_apply' AND o = 'applied') / nullif(count(*) FILTER (WHERE e = 'auto_apply'), 0), 4), 1.0), CAST(count(*) FILTER (WHERE e = 'auto_apply') AS DOUBLE) FROM gv
UNION ALL SELECT 'review_routing_accuracy', coalesce(round(count(*) FILTER (WHERE e = 'require_review' AND o = 'review_required') / nullif(count(*) FILTER (WHERE e = 'require_review'), 0), 4), 1.0), CAST(count(*) FILTER (WHERE e = 'require_review') AS DOUBLE) FROM gv""")
def governance_metrics(spark, sf_dir):
    return V.governance_metrics(governance(spark, sf_dir))


@query("routing_counts", _GOV_CTE + "SELECT e AS expected_decision, o AS observed_status, CAST(count(*) AS DOUBLE) AS n FROM gv GROUP BY 1, 2")
def routing_counts(spark, sf_dir):
    return V.routing_counts(governance(spark, sf_dir))
