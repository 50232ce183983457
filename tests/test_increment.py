"""A ledger fed in batches, in and out of order, against the naive model; its states; killed and repeated batches."""

import random

import pytest
from pyspark.sql import functions as F

from claimweave.operators import ledger as L
from claimweave.operators.increment import RESETS, LedgerStore
from tests.test_fold import frames, model_of, random_log, tables


def expected(claims, control):
    models = model_of(claims, control)
    versions = {(k, v["id"], v["branch"], v["obj"], v["status"], v["prev"], v["conflict"], v["source"]) for k, m in models.items() for v in m.versions}
    return versions, sorted((k, l["v"], l["source"], l["rel"], l["status"], l["seq"]) for k, m in models.items() for l in m.links)


@pytest.mark.parametrize("seed,shuffled", [(1, False), (2, False), (3, True), (4, True)])
def test_batches_equal_one_fold(spark, tmp_path, seed, shuffled):
    claims, control = random_log(seed, keys=5, commits=60)
    seqs = sorted({c[1] for c in claims} | {c[0] for c in control})
    if shuffled:
        random.Random(seed).shuffle(seqs)
    store = None
    for i in range(5):
        part = set(seqs[i * len(seqs) // 5:(i + 1) * len(seqs) // 5])
        c, b, ctl = frames(spark, [x for x in claims if x[1] in part], [x for x in control if x[0] in part])
        store = store or LedgerStore(spark, str(tmp_path), b, buckets=4, full_states_every=2)
        store.apply(c, ctl)
    versions, links = tables(L.materialise(store.events(), "t"))
    assert (versions, links) == expected(claims, control)


def test_state_does_not_grow_with_claims_or_batches(spark, tmp_path):
    """Sources used once, two values in turn: states stay as they are, and later batches reopen nothing."""
    store, sizes = None, []
    for i in range(4):
        claims = [(f"k{s % 3}", s, 0, 1, s, 5000, "ab"[s // 30 % 2], 9000, None, None) for s in range(i * 120 + 1, i * 120 + 121)]
        c, b, _ = frames(spark, claims, [])
        store = store or LedgerStore(spark, str(tmp_path), b, buckets=2)
        store.apply(c)
        sizes.append(store.states().agg(F.max(F.length("state"))).first()[0])
    assert max(sizes[1:]) <= sizes[0] + 40
    assert store.tables.read("resets", RESETS).isEmpty()


def test_killed_and_repeated_batches_count_once(spark, tmp_path, monkeypatch):
    claims, control = random_log(7, keys=4, commits=30)
    c, b, ctl = frames(spark, claims, control)
    store = LedgerStore(spark, str(tmp_path), b)
    monkeypatch.setattr(store.tables, "commit", lambda epoch: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.apply(c, ctl)
    assert store.events().isEmpty() and store.log().isEmpty()
    monkeypatch.undo()
    assert store.apply(c, ctl, 0) == store.apply(c, ctl, 0) == 0
    versions, links = tables(L.materialise(store.events(), "t"))
    assert (versions, links) == expected(claims, control)


def test_only_buckets_of_the_batch_are_scanned(spark, tmp_path):
    c, b, _ = frames(spark, [(f"k{s}", s, 0, 1, s, 5000, "a", 9000, None, None) for s in range(1, 40)], [])
    store = LedgerStore(spark, str(tmp_path), b, buckets=16)
    store.apply(c)
    plan = store._of_keys(store.states(), c.where("seq = 1").select("claim_key"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("bucket#", "bucket") or "PartitionFilters: [(bucket" in plan.replace("bucket#", "bucket")
