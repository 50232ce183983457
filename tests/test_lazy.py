"""Tables are written by those who read them only."""

from pyspark.sql import functions as F

from claimweave.operators import checks as C, ledger as L, lifecycle as LC, retrieve as RV
from claimweave.plans import catalog_checks as CC, fixtures as fx

SF = "/root/testdata/sf0.001"


def test_a_ledger_writes_what_is_asked_for(spark, monkeypatch):
    written, write = [], L.materialise
    monkeypatch.setattr(L, "materialise", lambda df, name: written.append(name) or write(df, name))
    led = L.build_ledger(fx.as_ledger_claims(fx.event_claims(spark, SF)), fx.branches(spark))
    assert led.versions.count() > 0
    assert "versions" in written and not {"direct-links", "inherited", "rejected"} & set(written)
    assert led.direct.count() > 0 and led.rejected.isEmpty()


def test_checks_without_history_do_not_ask_for_it(spark):
    current = spark.createDataFrame([], "viewer_id long, claim_key string, version_id long, normalized_object string, valid_from date, valid_to date, score_units long, active_support_count long")

    def history():
        raise AssertionError("rolled-back history was built")

    x = C.check_input(CC.staged_writes(spark, SF), C.Snapshot(current, history, history, fx.document_sources(spark, SF)), today=CC.TODAY)
    assert C.check_contradiction(x).isEmpty() and C.check_support_gap(x).count() > 0


def test_states_are_chained_across_batches(spark, monkeypatch):
    monkeypatch.setattr(L, "STATE_ROWS", 3)
    claims = fx.as_ledger_claims(fx.event_claims(spark, SF)).withColumn("branch_id", F.lit(1).cast("long"))
    whole, cut = (L.versions_table(L.fold_events(claims, fx.branches(spark), options=o)) for o in (None, L.FoldOptions(chunk_rows=3)))
    assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty()


def _snapshot(spark):
    current = spark.createDataFrame([], "viewer_id long, claim_key string, version_id long, normalized_object string, valid_from date, valid_to date, score_units long, active_support_count long")
    versions = spark.createDataFrame([], "claim_key string, normalized_object string, status string, rolled_back boolean, version_id long")
    return C.Snapshot(current, versions, spark.createDataFrame([], "source_id long, status string, link_pos long"), fx.document_sources(spark, SF))


def test_the_gate_writes_a_row_per_write(spark, monkeypatch):
    written, write = [], C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, name: written.append(name) or write(df, name))
    x = C.check_input(CC.staged_writes(spark, SF), _snapshot(spark), today=CC.TODAY)
    writes, decisions, results = C.run_checks(x, messages=4)
    assert sorted(set(written)) == ["checked-writes", "claim-facts", "known-texts", "open-writes"]
    n = x.staged.count()
    assert writes.count() == n and results.where("reason_code <> 'no_claims'").select("staged_id", "check_name").distinct().count() == n * len(x.policy.checks)
    again = C.ci_decision(x.staged, results, x.policy.checks, messages=4).drop("failed")
    assert again.exceptAll(decisions).isEmpty() and decisions.exceptAll(again).isEmpty()


def test_an_added_check_counts_beside_the_own_ones(spark, monkeypatch):
    def odd(x):
        rows = x.staged.where("staged_id % 2 = 1").select("staged_id", F.lit("odd_check").alias("check_name"), F.lit("fail").alias("severity"), F.lit("odd").alias("reason_code"), F.lit("Odd.").alias("message"))
        return rows.unionByName(rows)

    monkeypatch.setitem(C.REGISTRY, "odd_check", odd)
    policy = C.Policy(checks=("low_trust_source_check", "odd_check"))
    x = C.check_input(CC.staged_writes(spark, SF).where("staged_id % 97 <> 0"), _snapshot(spark), today=CC.TODAY, policy=policy)
    writes, decisions, results = C.run_checks(x)
    assert results.groupBy("staged_id").count().where("count <> 2").isEmpty()
    assert decisions.where("staged_id % 2 = 1 AND (decision <> 'quarantine' OR reason_summary NOT LIKE '%Odd.%')").isEmpty()
    assert not decisions.where("staged_id % 2 = 0 AND decision <> 'quarantine'").isEmpty()


def test_a_snapshot_scores_current_versions_only(spark, monkeypatch):
    sizes, write = {}, L.materialise

    def told(df, name):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(L, "materialise", told)
    snapshot = CC.snapshot(spark, SF + "/")  # a name of its own: nothing of it is written yet
    led = CC.CL.main_ledger(spark, SF + "/")
    assert "direct-links" not in sizes and 0 < sizes["edge-events"] < led.events.count() / 2
    want = CC.R.current_versions(CC.CL.scored(led, spark, SF), fx.branches(spark)).where("viewer_id < 3")
    want = CC._renamed(want).select(snapshot.current.columns)
    assert want.exceptAll(snapshot.current).isEmpty() and snapshot.current.exceptAll(want).isEmpty()
    events = CC.CL.rollback_ledger(spark, SF).events
    ended = L.direct_links(events).where("status = 'rolled_back'")
    found = L.rolled_back_links(events)
    assert not ended.isEmpty() and ended.exceptAll(found).isEmpty() and found.exceptAll(ended).isEmpty()


def test_final_action_routes_once(spark):
    plan = CC.final_action(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "fellowship" not in plan  # routing is behind a written table


def test_an_excerpt_finds_the_words_of_a_line_once(spark):
    df = spark.createDataFrame([("Intro.\n" + "pad " * 200 + "apples\n\nPears\nAPPLES and pears " + "pad " * 200, "apples pears")], "t string, q string")
    cut = df.select(RV.focus_excerpt(F.col("t"), F.col("q"), 300, window=60).alias("x"))
    assert cut._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 2  # of the question and of a line
    lines = cut.first().x.split("\n...\n")
    assert len(lines) == 3 and lines[0].startswith("APPLES and pears") and lines[1].startswith("...") and "apples" in lines[1] and lines[2] == "Pears"


def test_review_rounds_write_what_decisions_change(spark, monkeypatch):
    seen, write = {}, LC.materialise
    monkeypatch.setattr(LC, "materialise", lambda df, name: seen.setdefault(name, df.columns) and write(df, name))
    staged = spark.createDataFrame([(1, "quarantined", True, "blocked", "x"), (2, "checked", False, None, "y")], "staged_id long, status string, review_required boolean, quarantine_release string, excerpt string")
    decisions = spark.createDataFrame([(1, "release", "r", "seen", None, 1), (1, "approve", "r", None, None, 2), (2, "apply", "r", None, None, 1), (2, "reject", "r", None, None, 2)],
                                      "staged_id long, action string, reviewer string, notes string, override boolean, seq int")
    state, refused = LC.decide(staged, decisions)
    got = {r.staged_id: (r.status, r.quarantine_release, r.decided_by, r.excerpt) for r in state.collect()}
    assert got == {1: ("applied", "released", "approve", "x"), 2: ("applied", None, "apply", "y")}
    assert [(r.staged_id, r.action, r.error) for r in refused.collect()] == [(2, "reject", "already final")]
    assert set(seen) == {"judged", "decided-state"} and "excerpt" not in {*seen["judged"], *seen["decided-state"]}


def test_writes_are_read_by_the_columns_asked_for(spark):
    x = C.check_input(CC.staged_writes(spark, SF), _snapshot(spark), today=CC.TODAY)
    writes, _, _ = C.run_checks(x)
    plan = writes.select("staged_id", "status")._jdf.queryExecution().executedPlan().toString()
    assert "review_required:boolean" in plan and "excerpt:string" not in plan and "claims:array" not in plan and "array_sort" not in plan
    facts = C.claim_facts(CC.staged_writes(spark, SF), _snapshot(spark), C.Policy())
    assert "Aggregate" not in facts._jdf.queryExecution().optimizedPlan().toString()  # a claim meets one version at most


def test_facts_of_keys_with_one_and_with_several_versions(spark):
    from datetime import date
    rows = [(1, f"user_{u}::{p}", i, f"obj_{i % 4}", date(2024, 1, 1 + i), None, 3000, 2) for u in range(0, 1500, 7) for p in CC.PREDICATES.values() for i in range(1 + u % 3)]
    current = spark.createDataFrame(rows, "viewer_id long, claim_key string, version_id long, normalized_object string, valid_from date, valid_to date, score_units long, active_support_count long")
    snapshot, policy = _snapshot(spark), C.Policy()
    snapshot.current = current
    writes = CC.staged_writes(spark, SF)
    v = current.select(F.col("viewer_id").alias("branch_id"), "claim_key", F.col("normalized_object").alias("v_object"), F.col("valid_from").alias("v_from"), F.col("valid_to").alias("v_to"), "score_units", "active_support_count")
    want = C.compared(C.proposed_claims(writes, policy).join(v, ["branch_id", "claim_key"], "left"), policy)
    got = C.claim_facts(writes, snapshot, policy)
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert not got.where("other_near > 1").isEmpty() and not got.where("same_near = 1").isEmpty()


def test_retracted_versions_are_those_of_the_versions_table(spark):
    events = CC.CL.rollback_ledger(spark, SF).events
    want, got = L.versions_table(events).where("status = 'retracted'"), L.retracted_versions(events)
    assert not want.isEmpty() and want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
