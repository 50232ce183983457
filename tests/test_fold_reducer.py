"""The reducer alone, over many random logs: whole, and in chunks threaded by ``fold.chain``."""

import pytest

from claimweave.operators import fold
from tests.test_fold import W, model_of, random_log

CHAINS = {1: (1,), 2: (2, 1), 3: (3, 2, 1)}


def operations(claims, control, key):
    undone = {c[3] for c in control if c[1] == "rollback"}
    retracted = {(c[4], c[3] // W) for c in control if c[1] == "retract"}
    merged = {c[3] for c in control if c[1] == "merge"}
    uses = {}
    for c in claims:
        if c[0] == key:
            uses[c[4]] = uses.get(c[4], 0) + 1
    ops = []
    for k, seq, ord_, branch, source, trust, obj, conf, vf, vt in claims:
        if k == key:
            ops.append(dict(pos=seq * W + ord_, seq=seq, op="claim", branch=branch, source=source, trust=trust, obj=obj,
                            nobj=obj, conf=conf, vf=vf, vt=vt, shared=uses[source] > 1 or branch in merged or branch == 3))
    for seq, op, branch, target, own in control:
        if own in (None, key):
            ops.append(dict(pos=seq * W, seq=seq, op=op, branch=branch, target=target, shared=True))
    for o in ops:
        o.update(chain=CHAINS[o["branch"]], hyp=o["branch"] != 1, pinned=o["seq"] in undone or (key, o["seq"]) in retracted)
    return sorted(ops, key=lambda o: o["pos"])


def statuses(events):
    return {e[2]: e[8] for e in events if e[1] in ("version", "status")}


@pytest.mark.parametrize("block", range(4))
def test_many_logs(block):
    for seed in range(block * 60, block * 60 + 60):
        claims, control = random_log(seed, keys=3, commits=90)
        for key, model in model_of(claims, control).items():
            expected = {v["id"]: v["status"] for v in model.versions}
            ops = operations(claims, control, key)
            whole = fold.KeyFold(key)
            for o in ops:
                whole.apply(o)
            assert statuses(whole.events) == expected

            chunks = [ops[i:i + 7] for i in range(0, len(ops), 7)]
            starts, settled, summaries = ["[]"] * len(chunks), [False] * len(chunks), [None] * len(chunks)
            for _ in range(len(chunks) + 2):
                for i, part in enumerate(chunks):
                    if not settled[i]:
                        kf = fold.KeyFold(key, starts[i], emit=False)
                        for o in part:
                            kf.apply(o)
                        summaries[i] = kf.summary()
                for i, state, ok in fold.chain(enumerate(summaries)):
                    starts[i], settled[i] = state, ok
                if all(settled):
                    break
            assert all(settled)
            events = []
            for i, part in enumerate(chunks):
                kf = fold.KeyFold(key, starts[i])
                for o in part:
                    kf.apply(o)
                events += kf.events
            assert events == whole.events
