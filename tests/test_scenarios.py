"""Small hand-written histories with known outcomes, all replayed in one fold (one key per scenario)."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from claimweave.functions.scores import as_score
from claimweave.operators import ledger as L, reads as R
from tests.test_fold import CLAIMS, CONTROL, W

DAY = dt.date
# key, seq, branch, object, trust, confidence, valid_from, valid_to
HISTORY = [
    ("supersede", 1, 1, "seoul", .8, .9, None, None), ("supersede", 2, 1, "busan", .8, .9, DAY(2026, 3, 1), None),
    ("support", 3, 1, "seoul", .45, .9, None, None), ("support", 4, 1, "seoul", .95, .9, None, None),
    ("undo_support", 5, 1, "seoul", .8, .9, None, None), ("undo_support", 6, 1, "seoul", .7, .9, None, None),
    ("conflict", 8, 1, "seoul", .95, .9, None, None), ("conflict", 9, 1, "atlantis", .2, .6, None, None),
    ("merge", 10, 2, "kyoto", .8, .9, None, None),
    ("isolated", 11, 1, "seoul", .8, .9, None, None), ("isolated", 12, 2, "kyoto", .8, .9, None, None),
    ("undo", 13, 1, "seoul", .8, .9, None, None), ("undo", 14, 1, "busan", .9, .9, None, None),
    ("windows", 15, 1, "a", .8, .9, DAY(2025, 1, 1), DAY(2025, 12, 31)), ("windows", 16, 2, "b", .8, .9, DAY(2026, 1, 1), None),
    ("retract", 17, 1, "seoul", .8, .9, None, None), ("retract", 18, 1, "busan", .9, .9, None, None),
]
CONTROLS = [(7, "rollback", 1, 6, None), (20, "rollback", 1, 14, None), (21, "retract", 1, 18 * W, "retract"), (22, "merge", 1, 2, None)]


@pytest.fixture(scope="module")
def led(spark):
    rows = [(k, s, 0, b, s, D(str(t)), o, o, D(str(c)), vf, vt) for k, s, b, o, t, c, vf, vt in HISTORY]
    branches = spark.createDataFrame([(1, "main", None, "active"), (2, "trial", 1, "active")], "id long, name string, parent_branch_id long, status string")
    ledger = L.build_ledger(spark.createDataFrame(rows, CLAIMS), branches, spark.createDataFrame(CONTROLS, CONTROL))
    sources = spark.createDataFrame([(r[4], f"ref{r[4]}", r[5]) for r in rows], "source_id long, source_ref string, trust_score decimal(6,4)")
    return ledger, branches, sources


def versions(led, key):
    return {r.version_id // W: r for r in led[0].versions.where(F.col("claim_key") == key).collect()}


def links(led, key):
    out = {}
    for r in led[0].links.where(F.col("claim_key") == key).collect():
        out.setdefault((r.version_id // W, r.relation, r.status), []).append(r.source_id)
    return out


def test_supersede(led):
    v, l = versions(led, "supersede"), links(led, "supersede")
    assert (v[1].status, v[2].status, v[2].supersedes_id) == ("superseded", "active", W)
    assert (2, "opposition", "active") not in l and l[(2, "opposition", "superseded")] == [1]


def test_support_keeps_governing_source(led):
    v, l = versions(led, "support"), links(led, "support")
    assert list(v) == [3] and v[3].source_id == 3 and sorted(l[(3, "support", "active")]) == [3, 4]
    t = R.evidence_totals(led[0].versions, led[0].direct, led[2], led[0].inherited).where("claim_key = 'support'").first()
    assert t.support_units == 14000


def test_rolled_back_corroboration(led):
    v, l = versions(led, "undo_support"), links(led, "undo_support")
    assert v[5].status == "active" and l[(5, "support", "active")] == [5] and l[(5, "support", "rolled_back")] == [6]


def test_open_conflict(led):
    v, l = versions(led, "conflict"), links(led, "conflict")
    assert {x.status for x in v.values()} == {"active"} and v[9].supersedes_id is None and v[8].conflict_group == v[9].conflict_group == "conflict:conflict"
    for n, other in ((8, 9), (9, 8)):
        assert l[(n, "support", "active")] == [n] and l[(n, "opposition", "active")] == [other]
    assert R.conflict_groups(led[0].versions).where("claim_key = 'conflict'").first().unresolved


def test_branch_write_then_merge(led):
    v = versions(led, "merge")
    assert (v[10].status, v[10].branch_id) == ("hypothetical", 2) and (v[22].status, v[22].branch_id, v[22].merged_from_id) == ("active", 1, 10 * W)


def test_branch_does_not_weaken_main(led):
    before_merge = [r for r in led[0].links.where("claim_key = 'isolated'").collect() if r.version_id // W == 11 and r.commit_seq < 22]
    assert [r.relation for r in before_merge] == ["support"]


def test_rollback_restores(led):
    v = versions(led, "undo")
    assert (v[13].status, v[14].status, v[14].rolled_back) == ("active", "retracted", True)


def test_retract_restores_nothing(led):
    v = versions(led, "retract")
    assert (v[17].status, v[18].status) == ("superseded", "retracted")


def test_as_of_across_merged_windows(led):
    scored = R.evidence_totals(led[0].versions, led[0].direct, led[2], led[0].inherited)
    spark = scored.sparkSession
    asked = spark.createDataFrame([("windows", DAY(2025, 6, 1)), ("windows", DAY(2026, 2, 1))], "claim_key string, as_of date")
    got = {r.as_of: r.object_value for r in R.truth_as_of(scored, asked, branch_id=1).collect()}
    assert got == {DAY(2025, 6, 1): "a", DAY(2026, 2, 1): "b"}
    assert {x.status for x in versions(led, "windows").values() if x.branch_id == 1} == {"active"}


def test_sums_equal_expanded_edges(led):
    lazy = R.evidence_totals(led[0].versions, led[0].direct, led[2], led[0].inherited).select("claim_key", "version_id", "score_units", "active_opposition_count")
    full = R.evidence_totals(led[0].versions, led[0].links, led[2]).select(*lazy.columns)
    assert lazy.exceptAll(full).isEmpty() and full.exceptAll(lazy).isEmpty()
    assert full.select(as_score(F.col("score_units")).alias("s")).where("s > 0").count() > 0


def test_fallback_to_ancestor(led):
    child = led[1].sparkSession.sql("SELECT CAST(2 AS BIGINT) AS branch_id")
    cur = {(r.claim_key, r.branch_id): r.depth for r in R.current_versions(led[0].versions, led[1], child).collect()}
    assert cur[("isolated", 2)] == 0 and ("isolated", 1) not in cur and cur[("support", 1)] == 1
