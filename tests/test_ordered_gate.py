"""The ordered gate against one write after the other in a plain model."""

import os
import random
from decimal import Decimal as D

import pytest

from claimweave.operators import checks as C, ledger as L, ordered_gate as G
from claimweave.operators.policy import Policy
from claimweave.plans import catalog_checks as CC, catalog_ledger as CL
from tests.model import Model, hu
from tests.test_fold import CLAIMS, PARENTS, day

POLICY = Policy()
CLASSES = {"payment_method": "financial", "lives_in": "identity_state", "due_date": "operational_deadline"}
ONE = 10_000


def one_by_one(writes, models, stored, dead=frozenset(), dead_texts=frozenset(), today=10**9):
    """Decisions of ``writes`` (id, branch, trust, excerpt, review, claims (key, predicate, obj, conf, vf, vt), wording)."""
    out, texts = {}, set(stored)
    for w in writes:
        on_main, fails, warns = w["branch"] == 1, 0, 0
        classes = [POLICY.by_name[CLASSES.get(c[1], "low_risk")] for c in w["claims"]] or [POLICY.by_name["low_risk"]]
        if w["trust"] < round(max(c.fail_below for c in classes) * ONE):
            fails += 1
        elif w["trust"] < round(max(c.warn_below for c in classes) * ONE):
            warns += 1
        facts = []
        for (key, _, obj, conf, vf, vt), cls in zip(w["claims"], classes):
            cur = models.setdefault(key, Model(PARENTS)).current(w["branch"])
            near = [v for v in cur if (v["vf"] or 0) <= (10**9 if vt is None else vt) and (vf or 0) <= (10**9 if v["vt"] is None else v["vt"])]
            other, same = [v for v in near if v["obj"] != obj], [v for v in cur if v["obj"] == obj]
            score, claimed = models[key].score, hu(w["trust"], conf)
            ge = lambda v: vf is not None and (v["vf"] is None or vf >= v["vf"])
            gt = lambda v: vf is not None and (v["vf"] is None or vf > v["vf"])
            backing = sum(len(models[key].of(v, "support")) for v in same)
            facts.append({
                "contra": on_main and not [v for v in same if v in near] and any(not ge(v) and claimed < score(v) for v in other), "tempo": any(not gt(v) for v in other),
                "other": bool(other), "spike": w["trust"] >= round(cls.jump_trust * ONE) and any(score(v) < round(cls.jump_support_below * ONE) for v in same),
                "guard": on_main and cls.review_on_main,
                "gap": on_main and (cls.support_needed > 1 or cls.review_on_main) and w["trust"] < round(cls.auto_apply_trust * ONE) and backing + 1 < cls.support_needed,
                "dead": (key, obj) in dead, "future": vf is not None and vf > today})
        some = lambda n: any(f[n] for f in facts)
        leak = on_main and not w["confirmed"] and (w["tentative"] or some("future"))
        fails += some("contra") + some("tempo") + (some("other") and w["merge"]) + (some("dead") or w["excerpt"] in dead_texts) + leak
        warns += some("guard") + some("spike") + some("gap") + (w["excerpt"] in texts)
        out[w["id"]] = "reject" if not w["claims"] else "quarantine" if fails else "require_review" if warns or w["review"] else "auto_apply"
        if out[w["id"]] == "auto_apply":
            texts.add(w["excerpt"])
            for i, (key, _, obj, conf, vf, vt) in enumerate(w["claims"]):
                models[key].claim(10**6 + w["id"], i, w["branch"], 10**7 + w["id"], w["trust"], obj, conf, vf, vt)
    return out


def replayed(log):
    models = {}
    for k, s, o, b, src, t, obj, conf, vf, vt in sorted(log, key=lambda c: (c[1], c[2])):
        models.setdefault(k, Model(PARENTS)).claim(s, o, b, src, t, obj, conf, vf, vt)
    return models


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches(spark, seed):
    rnd = random.Random(seed)
    names = ["favorite_color", "payment_method", "favorite_food", "hobby"]
    keys = [(f"s{i}::{n}", f"s{i}", n) for i in range(2) for n in names]
    log = [(rnd.choice(keys)[0], s, 0, rnd.choice([1, 1, 2]), s, rnd.randrange(4, 20) * 500, rnd.choice("abc"), rnd.randrange(3, 10) * 1000, rnd.choice([None, 10, 20]), None) for s in range(1, 25)]
    writes = []
    for i in range(70):
        claims = [(*rnd.choice(keys), rnd.choice("abc"), rnd.randrange(3, 10) * 1000, rnd.choice([None, 15, 25, 30 + i]), None) for _ in range(rnd.choice([0, 1, 1, 1, 2]))]
        writes.append({"id": i, "branch": rnd.choice([1, 1, 2, 3]), "trust": rnd.randrange(12, 21) * 500, "excerpt": f"note {rnd.randrange(90)}" + " merge" * (rnd.random() < 0.2), "review": rnd.random() < 0.1,
                       "raw": claims, "claims": [(c[0], c[2], *c[3:]) for c in claims], "tentative": False, "confirmed": False})
    for w in writes:
        w["merge"] = "merge" in w["excerpt"]
    want = one_by_one(writes, replayed(log), {"note 3"})
    assert list(want.values()).count("auto_apply") > 8

    branches = spark.createDataFrame([(1, "main", None), (2, "trial", 1), (3, "child", 2)], "id long, name string, parent_branch_id long")
    logged = spark.createDataFrame([(k, s, o, b, src, D(t) / ONE, obj, obj, D(c) / ONE, day(vf), day(vt)) for k, s, o, b, src, t, obj, c, vf, vt in log], CLAIMS)
    rows = [(w["id"], w["branch"], {1: "main", 2: "trial", 3: "child"}[w["branch"]], "proposed", [(s, n, o, D(c) / ONE, day(vf), day(vt)) for _, s, n, o, c, vf, vt in w["raw"]],
             f"w{w['id']}", w["excerpt"], D(w["trust"]) / ONE, "", w["review"], [], []) for w in writes]
    claim = "struct<subject:string,predicate:string,object_value:string,confidence:decimal(6,4),valid_from:date,valid_to:date>"
    staged = spark.createDataFrame(rows, f"staged_id long, branch_id long, branch_name string, status string, claims array<{claim}>, source_ref string, excerpt string, "
                                         "trust_score decimal(6,4), message string, review_required boolean, risk_reasons array<string>, warnings array<string>")
    events = L.materialise(L.fold_events(logged, branches, end_states=True), "log")
    sources = spark.createDataFrame([(1, "r", "Note 3.", D("0.9"))], "source_id long, source_ref string, excerpt string, trust_score decimal(6,4)")
    snapshot = C.Snapshot(None, L.versions_table(events), L.direct_links(events), sources)
    states = events.where("kind = 'state'").selectExpr("claim_key", "object_value AS state")
    got = {r.staged_id: r.decision for r in G.ordered_decisions(staged, states, branches, snapshot, today="2999-01-01", base=100).collect()}
    assert got == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
def test_query_equals_one_by_one(spark):
    sf = "/root/testdata/sf0.001"
    days = lambda d: None if d is None else d.toordinal() - 719163
    units = lambda x: int(x * ONE)
    log = [(r.claim_key, r.seq, r.ord, r.branch_id, r.source_id, units(r.trust_score), r.normalized_object, units(r.confidence), days(r.valid_from), days(r.valid_to))
           for r in CC._renamed(CL.main_claims(spark, sf)).collect()]
    undone = CL.rollback_ledger(spark, sf)
    gone = {r.source_id for r in undone.direct.where("status = 'rolled_back'").collect()}
    sources = {r.source_id: r.excerpt for r in CL.event_sources(spark, sf).collect()}
    dead = {(r.claim_key, r.normalized_object) for r in CC._renamed(undone.versions).where("rolled_back").collect()}
    writes = []
    for r in sorted(CC.staged_writes(spark, sf).collect(), key=lambda r: r.staged_id):
        claims = [(f"{c.subject}::{c.predicate.replace(' ', '_')}", c.predicate, c.object_value.lower(), units(c.confidence if c.confidence is not None else D("0.7")), days(c.valid_from), days(c.valid_to)) for c in r.claims]
        trip, sure = "trip" in r.excerpt, r.excerpt.startswith("Confirmed")
        writes.append({"id": r.staged_id, "branch": r.branch_id, "trust": units(r.trust_score), "excerpt": r.excerpt, "review": r.review_required, "claims": claims,
                       "tentative": trip, "confirmed": sure, "merge": "merge" in r.excerpt})
    from datetime import date
    want = one_by_one(writes, replayed(log), set(sources.values()), dead, {sources[s] for s in gone}, days(date.fromisoformat(CC.TODAY)))
    assert {r.staged_id: r.decision for r in CC.ordered_gate(spark, sf).collect()} == want
