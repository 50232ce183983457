"""Data that must not be lost: long near-equal lines, competing decisions, chains of branch requests, many merges, faulty claims."""

import random

import pytest
from pyspark.sql import functions as F

from claimweave.functions import text as X
from claimweave.operators import checks as C, evidence as E, ledger as L, lifecycle as LC, retrieve as RV
from claimweave.operators.increment import LedgerStore
from claimweave.streaming import ledger as SL


def test_lines_that_differ_late_are_kept(spark):
    long = "we sold $5 " + "x" * 600
    lines = spark.createDataFrame([(1, "s", "", 0, 0, long + "a"), (1, "s", "", 0, 1, long + "b"), (1, "s", "", 0, 2, long + "a")],
                                  "question_id int, source_ref string, session_date string, place int, line_no int, line string")
    assert E.evidence_money(lines).count() == 2
    assert E.evidence_money(lines, cap=1, limit=100).collect()[0].evidence.endswith("...")


def test_first_legal_decision_counts(spark):
    staged = spark.createDataFrame([(1, "checked", False, None), (2, "quarantined", True, None), (3, "checked", True, None), (4, "checked", False, None)],
                                   "staged_id int, status string, review_required boolean, quarantine_release string")
    rows = [(1, 1, "reject", None), (1, 2, "approve", None), (2, 1, "approve", None), (2, 2, "release", "why"), (2, 3, "apply", None), (2, 4, "approve", None), (2, 5, "reject", None),
            (3, 1, "apply", None), (3, 2, "approve", None), (9, 1, "apply", None)]
    decisions = spark.createDataFrame([(i, s, a, "r", n, False) for i, s, a, n in rows], "staged_id int, seq int, action string, reviewer string, notes string, override boolean")
    done, refused = LC.decide(staged, decisions)
    assert {r.staged_id: (r.status, r.quarantine_release) for r in done.collect()} == {1: ("rejected", None), 2: ("applied", "released"), 3: ("applied", None), 4: ("checked", None)}
    assert sorted((r.staged_id, r.action, r.error) for r in refused.collect()) == [
        (1, "approve", "already final"), (2, "apply", "review required"), (2, "approve", "quarantined"), (2, "reject", "already final"), (3, "apply", "review required"),
        (9, "apply", "unknown write")]


def one_by_one(requests):
    there, made, refused = {"main"}, [], []
    for seq, name, parent in sorted(requests, key=lambda r: r[0]):
        if name in there or (parent or "main") not in there:
            refused.append(seq)
        else:
            there.add(name)
            made.append((name, parent or "main", seq))
    return sorted(made), sorted(refused)


def test_branch_requests_in_order(spark):
    rnd = random.Random(5)
    fixed = [(1, "a", "ghost"), (2, "b", "a"), (3, "a", "main"), (4, "b", "a"), (5, "c", "b"), (6, "main", None)]
    for requests in (fixed, [(i, rnd.choice("abcdefgh"), rnd.choice([None, *"abcdefgh"])) for i in range(40)]):
        made, refused = LC.create_branches(spark.createDataFrame(requests, "seq long, name string, parent_name string"))
        got = sorted(tuple(r) for r in made.where("name <> 'main'").collect()), sorted(r.seq for r in refused.collect())
        assert got == one_by_one(requests)


def reach_one_by_one(merges):
    out = set()
    for seq, into, target in merges:
        todo, seen = [(target, seq)], set()
        while todo:
            branch, via = todo.pop()
            if (branch, via) in seen:
                continue
            seen.add((branch, via))
            out.add((branch, seq))
            todo += [(t, s) for s, i, t in merges if i == branch and s < via]
    return out


def test_many_merges(spark):
    rnd = random.Random(2)
    alternating = [(i, 1 + i % 2, 2 - i % 2) for i in range(1, 201)]
    mixed = [(i, a, b) for i in range(1, 40) for a, b in [rnd.sample(range(6), 2)]]
    for merges in (alternating, mixed):
        control = spark.createDataFrame([(s, "merge", i, t, None) for s, i, t in merges], "seq long, op string, branch_id long, target long, claim_key string")
        assert {tuple(r) for r in L._merge_reach(control).collect()} == reach_one_by_one(merges)


def test_bunched_hot_key_is_cut_evenly(spark):
    ops = spark.range(1000).select(F.lit("k").alias("claim_key"), F.when(F.col("id") < 990, F.col("id")).otherwise(F.col("id") * 10**9).alias("pos"))
    ops = ops.unionByName(spark.range(5).select(F.lit("cold").alias("claim_key"), F.col("id").alias("pos")))
    hot = L.hot_keys(ops, 100)
    sizes = {(r.claim_key, r.chunk): r["count"] for r in L._assign_chunks(ops, hot, 100).groupBy("claim_key", "chunk").count().collect()}
    assert sizes == {("cold", 0): 5, **{("k", c): 100 for c in range(10)}}


@pytest.mark.parametrize("subject,predicate,key", [("Ann", "lives in", "ann::lives_in"), ("Ann", None, None), ("", "x", None), (None, None, None)])
def test_claim_key_needs_both_parts(spark, subject, predicate, key):
    df = spark.createDataFrame([(subject, predicate)], "s string, p string")
    assert df.select(X.claim_key(F.col("s"), F.col("p")).alias("k")).first().k == key


def test_long_branch_names_stay_apart(spark):
    names = spark.createDataFrame([("n" * 60 + "a",), ("n" * 60 + "b",)], "v string").select(X.safe_branch_name(F.col("v"), keep_apart=True).alias("x"), X.safe_branch_name(F.col("v")).alias("y")).collect()
    assert len({r.x for r in names}) == 2 and all(len(r.x) == 40 for r in names) and {r.y for r in names} == {"n" * 40}


def test_stream_keeps_what_it_rejects(spark, tmp_path):
    rows = [(1, "a::b", "x", 1), (2, "a::b", "y", 99), (3, None, "x", 1), (4, "a::b", " ", 1), (None, "a::b", "x", 1), (6, "a::c", "z", 1), (7, "a::c", "z", None)]
    claims = spark.createDataFrame([(*r, 5) for r in rows], "seq long, claim_key string, object_value string, branch_id long, source_id long").select(
        "*", F.lit(0).alias("ord"), F.col("object_value").alias("normalized_object"), F.expr("0.8BD AS trust_score"), F.expr("0.8BD AS confidence"),
        F.expr("cast(null AS date) AS valid_from"), F.expr("cast(null AS date) AS valid_to"))
    branches = spark.createDataFrame([(1, "main", None)], "id long, name string, parent_branch_id long")
    SL.as_operations(claims).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SL.as_operations(claims).schema).parquet(f"{tmp_path}/in")
    store = SL.drain_ledger(stream, LedgerStore(spark, f"{tmp_path}/store", branches), f"{tmp_path}/seen")
    assert {(r.claim_key, r.commit_seq) for r in L.versions_table(store.events()).collect()} == {("a::b", 1), ("a::c", 6)}
    assert {(r.seq, r.error) for r in store.rejected().collect()} == {
        (2, "unknown branch"), (3, "subject or predicate missing"), (4, "object missing"), (None, "commit missing"), (7, "unknown branch")}


def test_summary_has_every_message(spark):
    staged = spark.createDataFrame([(1, False, [])], "staged_id int, review_required boolean, risk_reasons array<string>")
    names = list(C.OUTCOMES)[:6]
    results = spark.createDataFrame([(1, n, "fail", f"r{i}", f"Message {i}.", False) for i, n in enumerate(names)],
                                    "staged_id int, check_name string, severity string, reason_code string, message string, passed boolean")
    told = [C.ci_decision(staged, results, tuple(names), **k).first().reason_summary for k in ({}, {"messages": 4})]
    assert told == ["; ".join(f"Message {i}." for i in range(n)) for n in (6, 4)]


def test_excerpt_of_a_long_line(spark):
    line, other = "needle " + "x " * 900 + "end", "y " * 3000
    df = spark.createDataFrame([(line + "\n" + other, other + "needle " + other)], "a string, b string")
    a, b = df.select(RV.focus_excerpt(F.col("a"), F.lit("the needle"), 4000, window=None), RV.focus_excerpt(F.col("b"), F.lit("the needle"), 4000, window=None)).first()
    assert a == line and "needle" in b and b.startswith("...") and b.endswith("...") and 3990 < len(b) <= 4000
