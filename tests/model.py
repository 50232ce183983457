"""Plain model of the ledger rules, for comparison with the Spark fold.

Deliberately naive: every version and edge is an object, every lookup a scan.
"""

from __future__ import annotations

W = 1 << 20
CURRENT = ("active", "hypothetical")


def hu(net, conf):
    return (max(0, net) * conf + 5000) // 10000


class Model:
    def __init__(self, parents, main=1):
        self.parents, self.main, self.versions, self.links = parents, main, [], []

    def hyp(self, branch):
        return branch != self.main

    def current(self, branch):
        while branch is not None:
            here = [v for v in self.versions if v["branch"] == branch and v["status"] in CURRENT]
            if here:
                return sorted(here, key=lambda v: -v["id"])
            branch = self.parents[branch]
        return []

    def of(self, v, relation, status="active"):
        return [l for l in self.links if l["v"] == v["id"] and l["rel"] == relation and l["status"] == status]

    def score(self, v):
        return hu(sum(l["trust"] for l in self.of(v, "support")) - sum(l["trust"] for l in self.of(v, "opposition")), v["conf"])

    def add(self, v, source, trust, rel, seq, status="active"):
        if not any(l["source"] == source for l in self.of(v, rel, status)):
            self.links.append({"v": v["id"], "source": source, "trust": trust, "rel": rel, "status": status, "seq": seq})

    def claim(self, seq, ord_, branch, source, trust, obj, conf, vf=None, vt=None):
        cur = self.current(branch)
        lap = lambda v: ((v["vf"] or 0) <= (vt or 10**9)) and ((vf or 0) <= (v["vt"] or 10**9))
        near = [v for v in cur if lap(v)]
        same = [v for v in near if v["obj"] == obj]
        if same:
            for v in same:
                self.add(v, source, trust, "support", seq)
            return
        new_score = hu(trust, conf)
        if self.hyp(branch):
            beaten = list(near)
        else:
            beaten = [v for v in near if (vf is not None and (v["vf"] is None or vf >= v["vf"])) or new_score >= self.score(v)]
        conflict = len(beaten) < len(near)
        for v in beaten:
            if v["branch"] == branch:
                v["status"] = "superseded"
        for v in cur:
            if conflict and v["branch"] == branch:
                v["conflict"] = True
        new = {"id": seq * W + ord_, "seq": seq, "branch": branch, "obj": obj, "conf": conf, "vf": vf, "vt": vt,
               "status": "hypothetical" if self.hyp(branch) else "active", "source": source, "trust": trust,
               "prev": beaten[0]["id"] if beaten else None, "conflict": conflict}
        self.versions.append(new)
        self.add(new, source, trust, "support", seq)
        lost = {v["id"] for v in beaten}
        for v in near:
            if not (self.hyp(branch) and v["branch"] != branch):
                self.add(v, source, trust, "opposition", seq)
            backers = [(l["source"], l["trust"]) for l in self.of(v, "support")] or [(v["source"], v["trust"])]
            for s, t in backers:
                self.add(new, s, t, "opposition", seq, "superseded" if v["id"] in lost else "active")

    def end(self, v, status):
        for l in self.links:
            if l["v"] == v["id"] and l["status"] == "active":
                l["status"] = status

    def get(self, vid):
        return next((v for v in self.versions if v["id"] == vid), None)

    def retract(self, vid):
        v = self.get(vid)
        if v:
            v["status"] = "retracted"
            self.end(v, "removed")

    def rollback(self, target):
        for v in sorted((v for v in self.versions if v["seq"] == target), key=lambda v: v["id"]):
            if v["status"] != "retracted":
                v["status"] = "retracted"
                self.end(v, "rolled_back")
            prev = self.get(v["prev"]) if v["prev"] else None
            if prev is None or prev["status"] != "superseded":
                continue
            if not any(w["prev"] == prev["id"] and w["id"] != v["id"] and w["branch"] == prev["branch"]
                       and w["status"] in CURRENT for w in self.versions):
                prev["status"] = "hypothetical" if self.hyp(prev["branch"]) else "active"
        for l in self.links:
            if l["seq"] == target and l["status"] == "active":
                l["status"] = "rolled_back"
                v = self.get(l["v"])
                if v["seq"] != target and l["rel"] == "support" and v["status"] in CURRENT and not self.of(v, "support"):
                    v["status"] = "retracted"

    def merge(self, seq, source_branch, target_branch):
        waiting = sorted((v for v in self.versions if v["branch"] == source_branch and v["status"] in CURRENT), key=lambda v: v["id"])
        for j, v in enumerate(waiting):
            self.claim(seq, j, target_branch, v["source"], v["trust"], v["obj"], v["conf"], v["vf"], v["vt"])
