"""Ledger queries on claims derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimweave.functions.scores import as_score
from claimweave.operators import ledger as L, reads as R
from claimweave.plans import fixtures as fx
from claimweave.plans.ordered import numbered
from claimweave.plans.registry import once, query
from claimweave.plans.session import materialise

LATER = 1 << 31
"""Control operations take seq = LATER + something, after every event."""

# Closed form of the ledger on these claims: windows always overlap and each claim is at least as
# new as the one before, so versions are runs of equal objects in event order.
CLAIMS_CTE = """c AS (
  SELECT event_id AS seq, user_id, event_type, concat('user_', user_id, '::', event_type) AS claim_key,
         concat('obj_', CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4) AS object_value,
         CAST(CAST(event_id % 20 + 1 AS INT) * 0.05 AS DECIMAL(6,4)) AS trust_score,
         CAST(0.5 + CAST(user_id % 6 AS INT) * 0.1 AS DECIMAL(6,4)) AS confidence,
         CAST(ts AS DATE) AS valid_from
  FROM events)"""
RUNS_CTE = CLAIMS_CTE + """,
f AS (SELECT *, CASE WHEN lag(object_value) OVER w = object_value THEN 0 ELSE 1 END AS is_new
      FROM c WINDOW w AS (PARTITION BY claim_key ORDER BY seq)),
g AS (SELECT *, sum(is_new) OVER (PARTITION BY claim_key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS vno FROM f),
v AS (SELECT claim_key, min(user_id) AS user_id, min(event_type) AS event_type, vno, min(object_value) AS object_value,
             min(seq) AS version_seq, count(*) AS n_support, CAST(sum(trust_score) AS DECIMAL(12,4)) AS support_trust,
             min(confidence) AS confidence, min(valid_from) AS valid_from, arg_min(trust_score, seq) AS first_trust
      FROM g GROUP BY claim_key, vno),
isl AS (SELECT *, lag(version_seq) OVER w AS supersedes_seq, lag(n_support) OVER w AS prev_support,
               lead(version_seq) OVER w AS next_seq, coalesce(lead(first_trust) OVER w, 0) AS against,
               CASE WHEN lead(version_seq) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status,
               count(*) OVER (PARTITION BY claim_key) AS n_versions
        FROM v WINDOW w AS (PARTITION BY claim_key ORDER BY vno)),
isl_scored AS (SELECT *, CAST(round(CAST(greatest(support_trust - against, 0) * confidence AS DECIMAL(18,8)), 4) AS DOUBLE) AS score FROM isl)
"""
WITH_RUNS = "WITH " + RUNS_CTE


def event_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("source_id"), F.lit("event").alias("source_type"),
        F.concat(F.lit("ref_"), (F.col("event_id") % 7).cast("string")).alias("source_ref"),
        F.col("props").alias("excerpt"), fx.decimal_step(F.col("event_id") % 20 + 1).alias("trust_score"))


def branch_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised claims, the ledger's input table: written once, as a store would hold them."""
    return once(spark, "claims", sf_dir, build=lambda: materialise(fx.as_ledger_claims(fx.event_claims(spark, sf_dir)), "claims"))


def main_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same written claims, all on main."""
    return branch_claims(spark, sf_dir).withColumn("branch_id", F.lit(1).cast("long"))


def main_ledger(spark: SparkSession, sf_dir: str) -> L.Ledger:
    return once(spark, "main", sf_dir, build=lambda: L.build_ledger(main_claims(spark, sf_dir), fx.branches(spark)))


def branch_ledger(spark: SparkSession, sf_dir: str) -> L.Ledger:
    return once(spark, "branch", sf_dir, build=lambda: L.build_ledger(branch_claims(spark, sf_dir), fx.branches(spark)))


def control_rows(rows: DataFrame, op: str, seq, target, claim_key=None) -> DataFrame:
    return rows.select(
        seq.cast("long").alias("seq"), F.lit(op).alias("op"), F.lit(1).cast("long").alias("branch_id"),
        target.cast("long").alias("target"), (claim_key if claim_key is not None else F.lit(None)).cast("string").alias("claim_key"))


def rollbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undo the commit behind every key's current version."""
    last = main_ledger(spark, sf_dir).versions.where(R.is_current())
    return control_rows(last, "rollback", F.col("commit_seq") + LATER, F.col("commit_seq"))


def rollback_ledger(spark: SparkSession, sf_dir: str) -> L.Ledger:
    return once(spark, "rollback", sf_dir, build=lambda: L.build_ledger(
        main_claims(spark, sf_dir), fx.branches(spark), rollbacks(spark, sf_dir)))


def retract_ledger(spark: SparkSession, sf_dir: str) -> L.Ledger:
    def build():
        last = main_ledger(spark, sf_dir).versions.where(R.is_current())
        control = control_rows(last, "retract", F.col("commit_seq") + LATER, F.col("version_id"), F.col("claim_key"))
        return L.build_ledger(main_claims(spark, sf_dir), fx.branches(spark), control)
    return once(spark, "retract", sf_dir, build=build)


def merge_control(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT CAST({LATER} AS BIGINT) AS seq, 'merge' AS op, CAST(1 AS BIGINT) AS branch_id, "
                     "CAST(2 AS BIGINT) AS target, CAST(NULL AS STRING) AS claim_key")


def merge_ledger(spark: SparkSession, sf_dir: str) -> L.Ledger:
    return once(spark, "merge", sf_dir, build=lambda: L.build_ledger(
        branch_claims(spark, sf_dir), fx.branches(spark), merge_control(spark)))


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.belief_identity(main_claims(spark, sf_dir))


def scored(led: L.Ledger, spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.evidence_totals(led.versions, led.direct, event_sources(spark, sf_dir), led.inherited)


def seq_of(column: str):
    return F.shiftright(column, 20)


# -- the fold -------------------------------------------------------------------

_APPLIED = WITH_RUNS + """
SELECT claim_key, version_seq, object_value, status, supersedes_seq, confidence, valid_from,
       CASE WHEN supersedes_seq IS NULL THEN 'add' ELSE 'supersede' END AS action FROM isl"""


@query("apply_claims_chunked", _APPLIED)
def apply_claims_chunked(spark, sf_dir):
    """The same history with its larger keys folded in chunks, in parallel."""
    return _applied(L.fold_events(main_claims(spark, sf_dir), fx.branches(spark), options=L.FoldOptions(chunk_rows=10)))


@query("apply_claims", _APPLIED)
def apply_claims(spark, sf_dir):
    """The whole fold in one plan: log, reducer, final version table."""
    return _applied(L.fold_events(main_claims(spark, sf_dir), fx.branches(spark)))


def _applied(events: DataFrame) -> DataFrame:
    return L.versions_table(events).select(
        "claim_key", F.col("commit_seq").alias("version_seq"), "object_value", "status",
        seq_of("supersedes_id").alias("supersedes_seq"), "confidence", "valid_from", "action")


@query("classify_claims", WITH_RUNS + """
, r AS (SELECT g.*, sum(trust_score) OVER (PARTITION BY claim_key, vno ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g)
SELECT claim_key, seq, CASE WHEN is_new = 1 AND vno = 1 THEN 'add' WHEN is_new = 1 THEN 'supersede'
       WHEN round(CAST(trust_score * confidence AS DECIMAL(18,8)), 4) > round(CAST(before * first_value(confidence) OVER (PARTITION BY claim_key, vno ORDER BY seq) AS DECIMAL(18,8)), 4) THEN 'corroborate'
       ELSE 'duplicate' END AS action FROM r""")
def classify_claims(spark, sf_dir):
    d = L.decisions_table(main_ledger(spark, sf_dir).events)
    return d.select("claim_key", seq_of("claim_pos").alias("seq"), "action")


@query("link_upsert", WITH_RUNS + """
SELECT claim_key, version_seq, 'support' AS relation, 'active' AS status, n_support AS n FROM isl
UNION ALL SELECT claim_key, version_seq, 'opposition', 'active', 1 FROM isl WHERE next_seq IS NOT NULL
UNION ALL SELECT claim_key, version_seq, 'opposition', 'superseded', prev_support FROM isl WHERE prev_support IS NOT NULL""")
def link_upsert(spark, sf_dir):
    links = main_ledger(spark, sf_dir).links
    return links.groupBy("claim_key", seq_of("version_id").alias("version_seq"), "relation", "status").agg(F.count("*").alias("n"))


@query("retract_version", WITH_RUNS + """
SELECT claim_key, version_seq, CASE WHEN next_seq IS NULL THEN 'retracted' ELSE status END AS status,
       CASE WHEN next_seq IS NULL THEN n_support ELSE 0 END AS removed_links FROM isl""")
def retract_version(spark, sf_dir):
    led = retract_ledger(spark, sf_dir)
    gone = led.links.where("status = 'removed'").groupBy("claim_key", "version_id").agg(F.count("*").alias("n"))
    return led.versions.join(gone, R.KEY, "left").select(
        "claim_key", F.col("commit_seq").alias("version_seq"), "status", F.coalesce("n", F.lit(0)).cast("long").alias("removed_links"))


@query("rollback_commit", WITH_RUNS + """
SELECT claim_key, version_seq, object_value,
       CASE WHEN next_seq IS NULL THEN 'retracted' WHEN vno = n_versions - 1 THEN 'active' ELSE 'superseded' END AS status,
       CASE WHEN vno = n_versions - 1 THEN CAST(round(CAST(support_trust * confidence AS DECIMAL(18,8)), 4) AS DOUBLE) END AS restored_score
FROM isl""")
def rollback_commit(spark, sf_dir):
    led = rollback_ledger(spark, sf_dir)
    s = scored(led, spark, sf_dir)
    return s.select("claim_key", F.col("commit_seq").alias("version_seq"), "object_value", "status",
                    F.when(R.is_current(), as_score(F.col("score_units"))).alias("restored_score"))


@query("merge_branch", WITH_RUNS + f"""
SELECT claim_key, version_seq, CASE WHEN user_id % 5 = 0 THEN 2 ELSE 1 END AS branch_id, object_value,
       CASE WHEN user_id % 5 = 0 AND status = 'active' THEN 'hypothetical' ELSE status END AS status FROM isl
UNION ALL SELECT claim_key, {LATER}, 1, object_value, 'active' FROM isl WHERE user_id % 5 = 0 AND next_seq IS NULL""")
def merge_branch(spark, sf_dir):
    led = merge_ledger(spark, sf_dir)
    return led.versions.select("claim_key", F.col("commit_seq").alias("version_seq"), F.col("branch_id").cast("int").alias("branch_id"),
                               "object_value", "status")


@query("rejected_claims", """
SELECT event_id AS seq, CASE WHEN event_id % 5 = 1 THEN 'subject or predicate missing' WHEN event_id % 5 = 2 THEN 'object missing' ELSE 'unknown branch' END AS error
FROM events WHERE event_id % 5 IN (1, 2, 3)""")
def rejected_claims(spark, sf_dir):
    """Claims without a predicate, without an object, or on a branch that does not exist, beside good ones."""
    seq = F.col("seq")
    claims = main_claims(spark, sf_dir)
    broken = claims.withColumns({
        "claim_key": F.when(seq % 5 != 1, F.col("claim_key")), "object_value": F.when(seq % 5 == 2, F.lit(" ")).otherwise(F.col("object_value")),
        "branch_id": F.when(seq % 5 == 3, F.lit(99)).otherwise(F.lit(1)).cast("long")})
    return L.rejected_claims(broken, fx.branches(spark)).select("seq", "error")


@query("create_branch", """
WITH b AS (SELECT min(event_id) AS seq, user_id FROM events GROUP BY user_id)
SELECT concat('user-', user_id) AS name, 'main' AS parent_name, seq AS created_seq FROM b
UNION ALL SELECT 'main', NULL, NULL""")
def create_branch(spark, sf_dir):
    """A branch per user requested by each event: first request wins, the parent defaults to main."""
    from claimweave.operators.lifecycle import create_branches
    requests = fx.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("user-"), F.col("user_id")).alias("name"),
        F.lit(None).cast("string").alias("parent_name"))
    made, _ = create_branches(requests)
    return made.select("name", "parent_name", "created_seq")


@query("commit_log", """
WITH c AS (SELECT event_id AS seq, CASE WHEN user_id % 5 = 0 THEN 2 ELSE 1 END AS branch_id FROM events)
SELECT seq, branch_id, lag(seq) OVER (PARTITION BY branch_id ORDER BY seq) AS parent_seq FROM c""")
def commit_log(spark, sf_dir):
    log = R.commit_log(branch_claims(spark, sf_dir))
    return log.select("seq", F.col("branch_id").cast("int").alias("branch_id"), "parent_seq")


@query("latest_commit", """
SELECT CASE WHEN user_id % 5 = 0 THEN 2 ELSE 1 END AS branch_id, max(event_id) AS latest_seq FROM events GROUP BY 1""")
def latest_commit(spark, sf_dir):
    """The commit each branch's next commit will have as its parent."""
    return branch_claims(spark, sf_dir).groupBy(F.col("branch_id").cast("int").alias("branch_id")).agg(F.max("seq").alias("latest_seq"))


@query("belief_identity", """
SELECT concat('user_', user_id, '::', event_type) AS claim_key, min(event_id) AS first_seq,
       concat('user_', min(user_id)) AS subject, min(event_type) AS predicate FROM events GROUP BY user_id, event_type""")
def belief_identity(spark, sf_dir):
    return beliefs(spark, sf_dir)


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that happened in the rollback ledger, sources, branches and control operations included."""
    claims, control = main_claims(spark, sf_dir), rollbacks(spark, sf_dir)
    commits = claims.select("seq").distinct().unionByName(control.select("seq"))
    sources = claims.groupBy("source_id").agg(F.min("seq").alias("seq"))
    made = fx.branches(spark).select("id", "name", F.lit(0).cast("long").alias("created_seq"))
    return R.audit_log(rollback_ledger(spark, sf_dir).events, commits, beliefs(spark, sf_dir), sources=sources, branches=made, control=control)


_AUDIT_SQL = WITH_RUNS + f"""
, a AS (SELECT version_seq AS seq, 'belief_version.created' AS event_type, claim_key AS entity_key, CAST(NULL AS BIGINT) AS entity_id, CAST(1 AS BIGINT) AS n FROM isl
  UNION ALL SELECT seq, 'belief_source.support_added', claim_key, NULL, 1 FROM c
  UNION ALL SELECT next_seq, 'belief_source.opposition_added', claim_key, NULL, 1 FROM isl WHERE next_seq IS NOT NULL
  UNION ALL SELECT version_seq, 'belief_source.opposition_added', claim_key, NULL, prev_support FROM isl WHERE prev_support IS NOT NULL
  UNION ALL SELECT seq, 'commit.created', NULL, seq, 1 FROM c
  UNION ALL SELECT version_seq + {LATER}, 'commit.created', NULL, version_seq + {LATER}, 1 FROM isl WHERE next_seq IS NULL
  UNION ALL SELECT version_seq + {LATER}, 'commit.rolled_back', NULL, version_seq, 1 FROM isl WHERE next_seq IS NULL
  UNION ALL SELECT min(seq), 'belief.created', claim_key, NULL, 1 FROM c GROUP BY claim_key
  UNION ALL SELECT seq, 'source.created', NULL, seq, 1 FROM c
  UNION ALL SELECT 0, 'branch.created', name, id, 1 FROM (VALUES (1, 'main'), (2, 'trial'), (3, 'trial-child')) AS t(id, name))"""


@query("audit_log", _AUDIT_SQL + """
SELECT seq, event_type, entity_key, entity_id, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY seq, event_type, entity_key, entity_id""")
def audit_log(spark, sf_dir):
    """Rows of every change, rollbacks included; versions are told by key and commit."""
    rows = _audit(spark, sf_dir)
    return rows.groupBy("seq", "event_type", "entity_key", F.when(F.col("entity_type") != "belief_version", F.col("entity_id")).alias("entity_id")).agg(F.sum("n").alias("n"))


# -- reads ------------------------------------------------------------------------

@query("branch_ancestry", """
SELECT * FROM (VALUES (1, 1, 0), (2, 2, 0), (2, 1, 1), (3, 3, 0), (3, 2, 1), (3, 1, 2)) AS t(branch_id, ancestor_id, depth)
UNION ALL SELECT 10 + n_nationkey, 10 + n_nationkey, 0 FROM nation
UNION ALL SELECT 10 + n_nationkey, 2, 1 FROM nation UNION ALL SELECT 10 + n_nationkey, 1, 2 FROM nation""")
def branch_ancestry(spark, sf_dir):
    """The three fixture branches plus one child of ``trial`` per nation."""
    extra = fx.table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 10).cast("long").alias("id"), F.col("n_name").alias("name"),
        F.lit(2).cast("long").alias("parent_branch_id"), F.lit("active").alias("status"))
    up = L.branch_ancestry(fx.branches(spark).unionByName(extra))
    return up.select(*[F.col(c).cast("int").alias(c) for c in ("branch_id", "ancestor_id", "depth")])


@query("support_score", WITH_RUNS + "SELECT claim_key, version_seq, score FROM isl_scored")
def support_score(spark, sf_dir):
    led = main_ledger(spark, sf_dir)
    s = R.support_score(led.versions, led.direct, event_sources(spark, sf_dir), led.inherited)
    return s.select("claim_key", seq_of("version_id").alias("version_seq"), "score")


@query("support_graph", WITH_RUNS + """
SELECT claim_key, version_seq, version_seq AS governing_source_id, score AS support_score,
       CAST(support_trust AS DOUBLE) AS active_support_trust_total, CAST(against AS DOUBLE) AS active_opposition_trust_total,
       CAST(greatest(support_trust - against, 0) AS DOUBLE) AS net_evidence_trust, n_support AS active_support_count,
       CAST(CASE WHEN next_seq IS NULL THEN 0 ELSE 1 END AS BIGINT) AS active_opposition_count FROM isl_scored""")
def support_graph(spark, sf_dir):
    led = main_ledger(spark, sf_dir)
    g = R.support_graph(led.versions, led.direct, event_sources(spark, sf_dir), led.inherited)
    return g.withColumn("version_seq", seq_of("version_id")).drop("version_id")


@query("version_detail", WITH_RUNS + """
SELECT concat('user_', user_id) AS subject, event_type AS predicate, object_value, status,
       concat('ref_', version_seq % 7) AS source_ref, 'main' AS branch_name, version_seq FROM isl""")
def version_detail(spark, sf_dir):
    led = main_ledger(spark, sf_dir)
    d = R.version_detail(led.versions, beliefs(spark, sf_dir), event_sources(spark, sf_dir), fx.branches(spark))
    return d.select("subject", "predicate", "object_value", "status", "source_ref", "branch_name", F.col("commit_seq").alias("version_seq"))


@query("link_detail", WITH_RUNS + """
SELECT g.claim_key, isl.version_seq, g.seq AS source_id, concat('ref_', g.seq % 7) AS source_ref, CAST(g.trust_score AS DOUBLE) AS trust_score,
       e.props AS excerpt, 'active' AS status
FROM g JOIN isl ON g.claim_key = isl.claim_key AND g.vno = isl.vno JOIN events e ON e.event_id = g.seq""")
def link_detail(spark, sf_dir):
    led = main_ledger(spark, sf_dir)
    d = R.link_detail(led.direct.where("relation = 'support'"), event_sources(spark, sf_dir))
    return d.select("claim_key", seq_of("version_id").alias("version_seq"), "source_id", "source_ref",
                    F.col("trust_score").cast("double").alias("trust_score"), "excerpt", "status")


@query("current_versions", WITH_RUNS + """
SELECT claim_key, version_seq, object_value, CASE WHEN user_id % 5 = 0 THEN 'hypothetical' ELSE 'active' END AS status,
       CASE WHEN user_id % 5 = 0 THEN 1 ELSE 2 END AS depth FROM isl WHERE next_seq IS NULL""")
def current_versions(spark, sf_dir):
    """What the grandchild branch sees: trial's versions where it has any, else main's."""
    led = branch_ledger(spark, sf_dir)
    viewer = spark.sql("SELECT CAST(3 AS BIGINT) AS branch_id")
    cur = R.current_versions(led.versions, fx.branches(spark), viewer)
    return cur.select("claim_key", F.col("commit_seq").alias("version_seq"), "object_value", "status", "depth")


def visible_main(spark, sf_dir) -> DataFrame:
    led = main_ledger(spark, sf_dir)
    viewer = spark.sql("SELECT CAST(1 AS BIGINT) AS branch_id")
    return R.current_versions(scored(led, spark, sf_dir), fx.branches(spark), viewer)


@query("choose_current", WITH_RUNS + "SELECT claim_key, version_seq, object_value, status FROM isl WHERE next_seq IS NULL")
def choose_current(spark, sf_dir):
    best = R.choose_current(visible_main(spark, sf_dir))
    return best.select("claim_key", seq_of("version_id").alias("version_seq"), "object_value", "status")


@query("exact_provenance", WITH_RUNS + """
, b AS (SELECT g.claim_key, g.vno, arg_max(seq, (trust_score, seq)) AS provenance_source_id FROM g GROUP BY g.claim_key, g.vno)
SELECT isl.claim_key, version_seq, provenance_source_id, concat('ref_', provenance_source_id % 7) AS source_ref
FROM isl JOIN b ON b.claim_key = isl.claim_key AND b.vno = isl.vno WHERE next_seq IS NULL""")
def exact_provenance(spark, sf_dir):
    led = main_ledger(spark, sf_dir)
    chosen = R.choose_current(visible_main(spark, sf_dir))
    p = R.exact_provenance(chosen, led.direct, event_sources(spark, sf_dir), fx.branches(spark))
    return p.select("claim_key", seq_of("version_id").alias("version_seq"), "provenance_source_id", "source_ref")


@query("support_set", WITH_RUNS + """
SELECT DISTINCT isl.claim_key, version_seq, concat('ref_', g.seq % 7) AS source_ref
FROM isl JOIN g ON g.claim_key = isl.claim_key AND g.vno = isl.vno WHERE next_seq IS NULL""")
def support_set(spark, sf_dir):
    led = main_ledger(spark, sf_dir)
    chosen = R.choose_current(visible_main(spark, sf_dir))
    s = R.support_set(chosen, led.direct, event_sources(spark, sf_dir), fx.branches(spark))
    return s.select("claim_key", seq_of("version_id").alias("version_seq"), "source_ref")


@query("truth_as_of", WITH_RUNS + """
, e AS (SELECT *, row_number() OVER (PARTITION BY claim_key ORDER BY valid_from DESC, score DESC, version_seq DESC) AS rn
        FROM isl_scored WHERE valid_from <= DATE '2024-01-15')
SELECT claim_key, DATE '2024-01-15' AS as_of, version_seq, object_value, status FROM e WHERE rn = 1""")
def truth_as_of(spark, sf_dir):
    s = scored(main_ledger(spark, sf_dir), spark, sf_dir)
    asked = beliefs(spark, sf_dir).select("claim_key", F.to_date(F.lit("2024-01-15")).alias("as_of"))
    t = R.truth_as_of(s, asked)
    return t.select("claim_key", "as_of", seq_of("version_id").alias("version_seq"), "object_value", "status")


@query("overlap_pairs", WITH_RUNS + """
SELECT c.claim_key, c.seq, isl.version_seq, c.object_value = isl.object_value AS same_object
FROM c JOIN isl ON c.claim_key = isl.claim_key AND isl.next_seq IS NULL AND isl.valid_from <= c.valid_from""")
def overlap_pairs(spark, sf_dir):
    """Every claim, taken as valid on its own day only, against its key's current version."""
    claims = main_claims(spark, sf_dir).withColumn("valid_to", F.col("valid_from"))
    current = main_ledger(spark, sf_dir).versions.where(R.is_current())
    p = R.overlap_pairs(claims, current)
    return p.select("claim_key", "seq", seq_of("version_id").alias("version_seq"), "same_object")


@query("windows_overlap", """
SELECT a.o_orderkey AS left_key, b.l_linenumber AS right_line,
       b.l_shipdate <= a.o_orderdate + INTERVAL 90 DAY AND a.o_orderdate <= b.l_shipdate + INTERVAL 30 DAY AS overlaps
FROM orders a JOIN lineitem b ON a.o_orderkey = b.l_orderkey""")
def windows_overlap(spark, sf_dir):
    from claimweave.functions.scores import windows_overlap as overlap
    o, l = fx.table(spark, sf_dir, "orders"), fx.table(spark, sf_dir, "lineitem")
    j = o.join(l, o.o_orderkey == l.l_orderkey)
    start, ship = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    return j.select(F.col("o_orderkey").alias("left_key"), F.col("l_linenumber").alias("right_line"),
                    overlap(start, F.date_add(start, 90), ship, F.date_add(ship, 30)).alias("overlaps"))


@query("lineage_closure", WITH_RUNS + "SELECT claim_key, version_seq, status FROM isl WHERE n_versions > 1")
def lineage_closure(spark, sf_dir):
    v = R.lineage_closure(main_ledger(spark, sf_dir).versions)
    return v.select("claim_key", F.col("commit_seq").alias("version_seq"), "status")


@query("lineage_pairs", WITH_RUNS + """
SELECT isl.claim_key, version_seq, CASE WHEN supersedes_seq IS NOT NULL THEN 'supersedes' ELSE 'superseded predecessor' END AS relation,
       object_value, status, lag(object_value) OVER (PARTITION BY claim_key ORDER BY vno) AS predecessor_object,
       CASE WHEN supersedes_seq IS NOT NULL THEN 'superseded' END AS predecessor_status
FROM isl WHERE n_versions > 1""")
def lineage_pairs(spark, sf_dir):
    p = R.lineage_pairs(main_ledger(spark, sf_dir).versions)
    return p.select("claim_key", seq_of("version_id").alias("version_seq"), "relation", "object_value", "status",
                    "predecessor_object", "predecessor_status")


@query("source_node_rollup", WITH_RUNS + """
, ev AS (SELECT event_id AS source_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS k FROM events WHERE event_id % 4 <> 0)
SELECT e.event_id AS source_id, CAST(coalesce(ev.k, 0) AS BIGINT) AS evidence_count,
       CAST(CASE WHEN isl.version_seq IS NULL THEN 0 ELSE 1 END AS BIGINT) AS version_count,
       coalesce(isl.supersedes_seq IS NOT NULL OR isl.status = 'superseded', false) AS has_lineage, e.event_id % 9 = 0 AS is_quarantined
FROM events e LEFT JOIN ev ON ev.source_id = e.event_id LEFT JOIN isl ON isl.version_seq = e.event_id""")
def source_node_rollup(spark, sf_dir):
    s = event_sources(spark, sf_dir).withColumn("ci_status", F.when(F.col("source_id") % 9 == 0, "quarantined"))
    evidence = s.where("source_id % 4 <> 0").select(
        "source_id", F.explode(F.sequence(F.lit(1), F.when(F.col("source_id") % 3 == 0, 2).otherwise(1))).alias("line"))
    return R.source_node_rollup(s, evidence, main_ledger(spark, sf_dir).versions)


@query("belief_timeline", WITH_RUNS + "SELECT claim_key, CAST(vno AS BIGINT) AS position, version_seq, object_value, status FROM isl")
def belief_timeline(spark, sf_dir):
    t = R.belief_timeline(main_ledger(spark, sf_dir).versions)
    return t.select("claim_key", "position", F.col("commit_seq").alias("version_seq"), "object_value", "status")


@query("history_by_valid_time", WITH_RUNS + """
SELECT claim_key, row_number() OVER (PARTITION BY claim_key ORDER BY valid_from NULLS FIRST, version_seq) AS position, object_value, valid_from FROM isl
WHERE next_seq IS NOT NULL""")
def history_by_valid_time(spark, sf_dir):
    """After the last commit of every key was rolled back, so each history misses its last version."""
    h = R.history_by_valid_time(rollback_ledger(spark, sf_dir).versions)
    return h.select("claim_key", "position", "object_value", "valid_from")


@query("branch_diff", WITH_RUNS + "SELECT claim_key, version_seq, object_value, 'hypothetical' AS status FROM isl WHERE user_id % 5 = 0 AND next_seq IS NULL")
def branch_diff(spark, sf_dir):
    v = branch_ledger(spark, sf_dir).versions.where((F.col("branch_id") == 2) & R.is_current())
    return v.select("claim_key", F.col("commit_seq").alias("version_seq"), "object_value", "status").orderBy("version_seq")


@query("status_counts", WITH_RUNS + "SELECT status, count(*) AS n FROM isl GROUP BY status")
def status_counts(spark, sf_dir):
    return main_ledger(spark, sf_dir).versions.groupBy("status").agg(F.count("*").alias("n"))


@query("search_versions", WITH_RUNS + """
SELECT claim_key, version_seq, object_value, status FROM isl WHERE contains(concat('user_', user_id), 'user_1')
ORDER BY version_seq DESC LIMIT 25""")
def search_versions(spark, sf_dir):
    led = main_ledger(spark, sf_dir)
    d = R.version_detail(led.versions, beliefs(spark, sf_dir), event_sources(spark, sf_dir), fx.branches(spark))
    found = R.search_versions(d, "USER_1", include_inactive=True, limit=25)
    return found.select("claim_key", F.col("commit_seq").alias("version_seq"), "object_value", "status")


@query("commit_history", WITH_RUNS + """
SELECT version_seq AS seq, 1 AS branch_id FROM isl WHERE claim_key = 'user_1::click'""")
def commit_history(spark, sf_dir):
    commits = main_claims(spark, sf_dir).select("seq", F.col("branch_id").cast("int").alias("branch_id")).distinct()
    return R.commit_history(commits, main_ledger(spark, sf_dir).versions, claim_key="user_1::click")


@query("audit_filter", WITH_RUNS + """
SELECT version_seq AS seq, 'belief_version.created' AS event_type, claim_key AS entity_key FROM isl ORDER BY version_seq DESC LIMIT 100""")
def audit_filter(spark, sf_dir):
    led = main_ledger(spark, sf_dir)
    audit = R.audit_log(led.events, main_claims(spark, sf_dir).select("seq").distinct(), beliefs(spark, sf_dir))
    created = audit.where("event_type = 'belief_version.created'")
    return R.audit_filter(created, 100, entity_type="belief_version").select("seq", "event_type", "entity_key")


@query("backfill_links", WITH_RUNS + """
SELECT claim_key, version_seq, version_seq AS source_id, 'support' AS relation,
       CASE WHEN next_seq IS NULL THEN 'removed' ELSE 'active' END AS status FROM isl""")
def backfill_links(spark, sf_dir):
    b = R.backfill_links(rollback_ledger(spark, sf_dir).versions)
    return b.select("claim_key", seq_of("version_id").alias("version_seq"), "source_id", "relation", "status")


# Seven claims per key, of which each meets another rule of the fold: the action of the i-th.
ACTIONS = ("add", "corroborate", "duplicate", "coexist", "branch_override", "supersede", "unresolved_conflict")
_SCRIPT = """SELECT CAST(step AS BIGINT) AS step, object_value, CAST(trust AS DECIMAL(6,4)) AS trust_score, CAST(conf AS DECIMAL(6,4)) AS confidence, CAST(branch AS BIGINT) AS branch_id,
  CAST(f AS DATE) AS valid_from, CAST(t AS DATE) AS valid_to FROM VALUES
  (0, 'a', 0.5, 0.8, 1, '2024-01-01', '2024-06-30'), (1, 'a', 0.9, 0.8, 1, '2024-01-01', '2024-06-30'), (2, 'a', 0.3, 0.8, 1, '2024-01-01', '2024-06-30'),
  (3, 'b', 0.5, 0.8, 1, '2025-01-01', '2025-06-30'), (4, 'c', 0.5, 0.8, 2, '2024-02-01', '2024-03-01'), (5, 'd', 0.5, 0.8, 1, '2024-03-01', '2024-04-01'),
  (6, 'e', 0.05, 0.5, 1, NULL, '2024-03-15') AS s(step, object_value, trust, conf, branch, f, t)"""
_ACTION_CTE = """WITH ac AS (SELECT event_id AS seq, concat('user_', user_id, '::', event_type, '_', (rn - 1) // 7) AS claim_key, (rn - 1) % 7 AS step
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events))"""


def action_ledger(spark: SparkSession, sf_dir: str) -> L.Ledger:
    """Every user's events of a type in their order, seven to a key, told as the script has it."""
    def build():
        e = numbered(fx.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"])
        key = F.concat(F.lit("user_"), "user_id", F.lit("::"), "event_type", F.lit("_"), F.floor((F.col("position") - 1) / 7))
        rows = e.withColumn("step", (F.col("position") - 1) % 7).join(F.broadcast(spark.sql(_SCRIPT)), "step")  # seven rows
        claims = rows.select(key.alias("claim_key"), F.col("event_id").alias("seq"), F.lit(0).alias("ord"), "branch_id", F.col("event_id").alias("source_id"), "trust_score",
                             "object_value", F.col("object_value").alias("normalized_object"), "confidence", "valid_from", "valid_to")
        return L.build_ledger(claims, fx.branches(spark))
    return once(spark, "actions", sf_dir, build=build)


@query("classify_actions", _ACTION_CTE + f"SELECT claim_key, seq, list_extract({list(ACTIONS)}, CAST(step + 1 AS INT)) AS action FROM ac")
def classify_actions(spark, sf_dir):
    """What the fold decides for claims of which each meets another of its seven rules."""
    d = L.decisions_table(action_ledger(spark, sf_dir).events)
    return d.select("claim_key", seq_of("claim_pos").alias("seq"), "action")


@query("conflict_groups", _ACTION_CTE + """
SELECT claim_key, CASE WHEN count(*) = 7 THEN concat('conflict:', claim_key) END AS conflict_group, CAST(greatest(1, count(*) - 2) AS BIGINT) AS version_count,
       CAST(CASE WHEN count(*) = 7 THEN 3 ELSE 0 END AS BIGINT) AS open_objects, count(*) = 7 AS unresolved FROM ac GROUP BY claim_key""")
def conflict_groups(spark, sf_dir):
    return R.conflict_groups(action_ledger(spark, sf_dir).versions)


@query("branch_table", """
SELECT concat('user-', user_id) AS name, CASE WHEN bool_or(event_type = 'signup') THEN 'merged' ELSE 'active' END AS status,
       min(event_id) FILTER (WHERE event_type = 'signup') AS merged_seq FROM events GROUP BY user_id UNION ALL SELECT 'main', 'active', NULL""")
def branch_table(spark, sf_dir):
    """A branch per user, merged into main by the user's signups."""
    e = fx.table(spark, sf_dir, "events")
    made = e.select((F.col("user_id") + 10).cast("long").alias("id"), F.concat(F.lit("user-"), "user_id").alias("name"), F.lit(1).cast("long").alias("parent_branch_id")).distinct()
    made = made.unionByName(fx.branches(spark).where("id = 1").drop("status")).withColumn("status", F.lit("active"))
    merges = control_rows(e.where("event_type = 'signup'"), "merge", F.col("event_id"), F.col("user_id") + 10)
    return L.branches_after(made, merges).select("name", "status", "merged_seq")
