"""The Spark fold against a naive model, whole and cut into chunks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from claimweave.operators import ledger as L
from tests.model import Model, W

PARENTS = {1: None, 2: 1, 3: 2}
CLAIMS = ("claim_key string, seq long, ord int, branch_id long, source_id long, trust_score decimal(6,4), "
          "object_value string, normalized_object string, confidence decimal(6,4), valid_from date, valid_to date")
CONTROL = "seq long, op string, branch_id long, target long, claim_key string"
EPOCH = dt.date(1970, 1, 1)


def random_log(seed, keys=6, commits=60, shared_sources=True):
    rng = random.Random(seed)
    claims, control, written = [], [], []
    for seq in range(1, commits + 1):
        roll = rng.random()
        if roll < 0.08 and written:
            control.append((seq, "rollback", 1, rng.choice(written), None))
        elif roll < 0.12 and claims:
            c = rng.choice(claims)
            control.append((seq, "retract", 1, c[1] * W + c[2], c[0]))
        elif roll < 0.17:
            s, t = rng.choice([(2, 1), (3, 2), (3, 1)])
            control.append((seq, "merge", t, s, None))
        else:
            branch = rng.choice([1, 1, 1, 2, 3])
            source = rng.randrange(1, 12) if shared_sources and rng.random() < 0.5 else 1000 + seq
            trust = (source * 37 % 20 + 1) * 500
            for ord_ in range(rng.choice([1, 1, 2])):
                vf = None if rng.random() < 0.3 else rng.randrange(10, 40)
                vt = vf + rng.randrange(0, 20) if vf and rng.random() < 0.4 else None
                claims.append((f"k{rng.randrange(keys)}", seq, ord_, branch, source, trust, rng.choice("abcd"),
                               rng.randrange(3, 10) * 1000, vf, vt))
        written.append(seq)
    return claims, control


def model_of(claims, control):
    out = {}
    keys = sorted({c[0] for c in claims})
    for key in keys:
        m = Model(PARENTS)
        steps = [(c[1], c[2], "claim", c) for c in claims if c[0] == key]
        steps += [(c[0], 0, c[1], c) for c in control if c[4] in (None, key)]
        for seq, ord_, op, x in sorted(steps, key=lambda s: (s[0], s[1])):
            if op == "claim":
                m.claim(seq, ord_, x[3], x[4], x[5], x[6], x[7], x[8], x[9])
            elif op == "rollback":
                m.rollback(x[3])
            elif op == "retract":
                m.retract(x[3])
            else:
                m.merge(seq, x[3], x[2])
        out[key] = m
    return out


def day(n):
    return EPOCH + dt.timedelta(days=n) if n is not None else None


def frames(spark, claims, control):
    from decimal import Decimal as D
    rows = [(k, s, o, b, src, D(t) / 10000, obj, obj, D(c) / 10000, day(vf), day(vt))
            for k, s, o, b, src, t, obj, c, vf, vt in claims]
    branches = spark.createDataFrame([(1, "main", None, "active"), (2, "trial", 1, "active"), (3, "child", 2, "active")],
                                     "id long, name string, parent_branch_id long, status string")
    return spark.createDataFrame(rows, CLAIMS), branches, spark.createDataFrame(control, CONTROL)


def tables(events):
    v = {(r.claim_key, r.version_id, r.branch_id, r.normalized_object, r.status, r.supersedes_id,
          r.conflict_group is not None, r.source_id) for r in L.versions_table(events).collect()}
    l = sorted((r.claim_key, r.version_id, r.source_id, r.relation, r.status, r.commit_seq) for r in L.links_table(events).collect())
    return v, l


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_fold_matches_model_whole_and_chunked(spark, seed):
    claims, control = random_log(seed, keys=3, commits=90)
    expected = model_of(claims, control)
    ev = {(k, v["id"], v["branch"], v["obj"], v["status"], v["prev"], v["conflict"], v["source"])
          for k, m in expected.items() for v in m.versions}
    el = sorted((k, l["v"], l["source"], l["rel"], l["status"], l["seq"]) for k, m in expected.items() for l in m.links)
    c, b, ctl = frames(spark, claims, control)
    for rows in (10_000, 9):
        options = L.FoldOptions(chunk_rows=rows, wide_rounds=seed % 2 + 1, window=2)
        got_v, got_l = tables(L.materialise(L.fold_events(c, b, ctl, options), "t"))
        assert got_v == ev
        assert got_l == el


def test_single_object_hot_key_settles_quickly(spark, monkeypatch):
    """One key, one value, every claim its own source: sums differ in every chunk, the rounds must not."""
    rounds = []
    monkeypatch.setattr(L, "materialise", lambda df, name, _m=L.materialise: (rounds.append(name), _m(df, name))[1])
    claims = [("k", s, 0, 1, s, 5000, "a" if s % 9 else "b", 9000, None, None) for s in range(1, 400)]
    c, b, _ = frames(spark, claims, [])
    events = L.fold_events(c, b, None, L.FoldOptions(chunk_rows=20))
    assert rounds.count("states") <= 5
    m = model_of(claims, [])["k"]
    got = {(r.version_id, r.status) for r in L.versions_table(events).collect()}
    assert got == {(v["id"], v["status"]) for v in m.versions}


def test_deep_branch_tree(spark):
    """A chain of branches deeper than Spark's default recursion limit."""
    n = 130
    rows = [(i, "main" if i == 1 else f"b{i}", i - 1 if i > 1 else None, "active") for i in range(1, n + 1)]
    b = spark.createDataFrame(rows, "id long, name string, parent_branch_id long, status string")
    deepest = L.branch_chains(b).where(F.col("branch_id") == n).first()
    assert deepest.chain == ",".join(str(i) for i in range(n, 0, -1)) and deepest.hyp


def test_ancestors_of_one_branch_in_a_deep_tree(spark):
    """A chain of 10^4 branches: only the viewer's ancestors are listed, in a logarithm of rounds."""
    n = 10_000
    b = spark.range(1, n + 1).select(F.col("id"), F.concat(F.lit("b"), "id").alias("name"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_branch_id"))
    viewer = spark.createDataFrame([(n,), (7,), (n + 5,)], "branch_id long")
    got = L.branch_ancestry(b, viewer).groupBy("branch_id").agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.min("ancestor_id").alias("a")).collect()
    assert sorted(tuple(r) for r in got) == [(7, 7, 6, 1), (n, n, n - 1, 1)]


def test_oversized_commit_is_refused(spark):
    c, b, _ = frames(spark, [("k", 1, W, 1, 1, 5000, "a", 9000, None, None)], [])
    with pytest.raises(Exception, match="split it"):
        L.fold_events(c, b).collect()
