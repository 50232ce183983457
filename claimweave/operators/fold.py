"""Per-key history reducer.

The only imperative piece of the engine: operations of one claim key arrive in
commit order and become *events* (version created, status changed, edge added,
edges ended).  Everything else -- the version table, the edge table, scores,
audit trail -- is derived from those events with DataFrame operations.

The reducer is written so that its state stays small whatever the key's volume:

* supporters are kept as running sums; a source is kept by name only when the
  same source may turn up again under the key (``shared``) or when a later
  rollback may remove the edge it adds (``pinned``);
* edges a new version inherits from the versions it opposes are emitted as one
  ``inherit`` event per opposed version, with their number and trust sum; whoever
  needs them one by one expands them by a join afterwards;
* versions leave the state once nothing later can refer to them.

A key too large for one task is cut into chunks.  ``Summary`` records what a
chunk does to the state it was started from, and ``chain`` threads states
through the summaries of a key (see ``ledger.settle_hot_chunks``).

Trust and confidence are integers in units of 1e-4, so scores never depend on
summation order.
"""

from __future__ import annotations

import json
from operator import attrgetter
from typing import Any, Iterable, Iterator

ORD_BITS = 20
UNIT = 10_000
CURRENT = ("active", "hypothetical")

EVENT_FIELDS = (
    "claim_key", "kind", "version_id", "pos", "k", "branch_id", "source_id", "relation",
    "status", "other_id", "reason", "object_value", "normalized_object", "confidence",
    "valid_from", "valid_to", "conflict", "named", "n", "trust",
)


def scaled_score(net: int, confidence: int) -> int:
    """round(max(0, net) * confidence, 4) in units of 1e-4, half up."""
    return (max(0, net) * confidence + UNIT // 2) // UNIT


def _overlap(a_from, a_to, b_from, b_to) -> bool:
    return (a_from is None or b_to is None or a_from <= b_to) and (
        b_from is None or a_to is None or b_from <= a_to
    )


class Version:
    """A version that later operations of the key may still touch."""

    PLAIN = (
        "vid", "branch", "hyp", "status", "obj", "nobj", "conf", "vf", "vt", "source",
        "trust", "shared", "prev", "conflict", "pinned",
    )
    __slots__ = PLAIN + ("sup", "n_sup", "opp", "sup_by", "opp_by", "slot", "start", "low", "high", "exact")

    def __init__(self, **kw):
        self.sup = self.n_sup = self.opp = 0
        self.sup_by, self.opp_by = {}, {}
        self.slot, self.start, self.low, self.high, self.exact = None, 0, None, None, False
        for name, value in kw.items():
            setattr(self, name, value)

    @property
    def net(self) -> int:
        out = self.sup - self.opp
        if self.sup_by:
            out += sum(t for t, _ in self.sup_by.values())
        if self.opp_by:
            out -= sum(t for t, _ in self.opp_by.values())
        return out

    @property
    def supporters(self) -> int:
        return self.n_sup + len(self.sup_by)

    def dump(self) -> dict[str, Any]:
        out = {name: getattr(self, name) for name in self.PLAIN}
        out["sums"] = [self.sup, self.n_sup, self.opp]
        out["sup_by"] = {str(s): v for s, v in self.sup_by.items()}
        out["opp_by"] = {str(s): v for s, v in self.opp_by.items()}
        return out

    @classmethod
    def load(cls, raw: dict[str, Any], slot: int) -> "Version":
        v = cls(**{name: raw[name] for name in cls.PLAIN})
        v.sup, v.n_sup, v.opp = raw["sums"]
        v.sup_by = {int(s): tuple(x) for s, x in raw["sup_by"].items()}
        v.opp_by = {int(s): tuple(x) for s, x in raw["opp_by"].items()}
        v.slot, v.start = slot, v.net
        return v


_VID = attrgetter("vid")


class KeyFold:
    """State and transitions of one claim key (or one chunk of it)."""

    def __init__(self, key: str, state: str | None = None, *, keep_all: bool = False, emit: bool = True):
        self.key, self.keep_all, self.emitting = key, keep_all, emit
        self.incoming = json.loads(state) if state else []
        self.live: dict[int, Version] = {}
        self.current: dict[int, dict[int, Version]] = {}
        self.slots: list[Version] = []
        self.events: list[tuple] = []
        self._pos = self._k = 0
        for i, raw in enumerate(self.incoming):
            v = Version.load(raw, i)
            self.slots.append(v)
            self.live[v.vid] = v
            if v.status in CURRENT:
                self.current.setdefault(v.branch, {})[v.vid] = v

    # -- events ---------------------------------------------------------
    def _emit(self, kind, version_id=None, branch=None, source=None, relation=None, status=None,
              other=None, reason=None, version: Version | None = None, named=None, n=None, trust=None):
        if not self.emitting:
            return
        v = version
        if v is None:
            self.events.append((self.key, kind, version_id, self._pos, self._k, branch, source, relation, status, other, reason,
                                None, None, None, None, None, None, named, n, trust))
        else:
            self.events.append((self.key, kind, version_id, self._pos, self._k, branch, source, relation, status, other, reason,
                                v.obj, v.nobj, v.conf, v.vf, v.vt, v.conflict, named, n, trust))
        self._k += 1

    # -- small state moves ----------------------------------------------
    def _visible(self, chain: Iterable[int]) -> list[Version]:
        for branch in chain:
            here = self.current.get(branch)
            if here:
                return sorted(here.values(), key=_VID, reverse=True) if len(here) > 1 else list(here.values())
        return []

    def _set_status(self, v: Version, status: str, reason: str):
        v.status = status
        here = self.current.setdefault(v.branch, {})
        if status in CURRENT:
            here[v.vid] = v
        else:
            here.pop(v.vid, None)
            if not (v.pinned or self.keep_all):
                self.live.pop(v.vid, None)
        self._emit("status", v.vid, branch=v.branch, status=status, reason=reason)

    def _end_all_edges(self, v: Version, status: str):
        v.sup = v.n_sup = v.opp = 0
        v.sup_by, v.opp_by = {}, {}
        self._emit("end_all", v.vid, status=status)

    def _support(self, v: Version, source, trust, op, *, by_name: bool, reason: str):
        if source in v.sup_by:
            return
        if by_name:
            v.sup_by[source] = (trust, op["seq"])
        else:
            v.sup += trust
            v.n_sup += 1
        v.pinned = v.pinned or op["pinned"]
        self._emit("edge", v.vid, branch=op["branch"], source=source, relation="support", status="active",
                   reason=reason, named=by_name, trust=trust)

    def _oppose(self, v: Version, source, trust, op, *, by_name: bool, other: int):
        if source in v.opp_by:
            return
        if by_name:
            v.opp_by[source] = (trust, op["seq"])
        else:
            v.opp += trust
        v.pinned = v.pinned or op["pinned"]
        self._emit("edge", v.vid, branch=op["branch"], source=source, relation="opposition", status="active",
                   other=other, reason="contradicted by version", named=by_name, trust=trust)

    def _at_least(self, claimed: int, v: Version) -> bool:
        """claimed >= score(v), remembering for which starting sums that answer holds."""
        verdict = claimed >= scaled_score(v.net, v.conf)
        if v.slot is not None and v.conf > 0:
            edge = ((claimed + 1) * UNIT - UNIT // 2 - 1) // v.conf - (v.net - v.start)
            if verdict:
                v.high = edge if v.high is None else min(v.high, edge)
            else:
                v.low = edge + 1 if v.low is None else max(v.low, edge + 1)
        return verdict

    # -- operations -----------------------------------------------------
    def apply(self, op: dict[str, Any]):
        self._pos, self._k = op["pos"], 0
        kind = op["op"]
        if kind == "claim":
            self._claim(op, op["pos"], op)
        elif kind == "merge":
            waiting = sorted(self.current.get(op["target"], {}).values(), key=lambda v: v.vid)
            for j, v in enumerate(waiting):
                claim = {"source": v.source, "trust": v.trust, "obj": v.obj, "nobj": v.nobj, "conf": v.conf,
                         "vf": v.vf, "vt": v.vt, "shared": True, "from": v.vid}
                self._claim(claim, op["pos"] + j, op)
        elif kind == "probe":
            for v in self._visible(op["chain"]):
                self._emit("probe", v.vid, branch=v.branch, source=v.source, status=v.status, version=v, n=v.supporters, trust=scaled_score(v.net, v.conf))
        elif kind == "retract":
            self._touch_sums()
            v = self.live.get(op["target"])
            if v is not None:
                self._end_all_edges(v, "removed")
                self._set_status(v, "retracted", "retracted")
        elif kind == "rollback":
            self._touch_sums()
            self._rollback(op)

    def _touch_sums(self):
        for v in self.slots:
            v.exact = True

    def _claim(self, c, vid: int, op):
        cur = self._visible(op["chain"])
        near = [v for v in cur if _overlap(v.vf, v.vt, c["vf"], c["vt"])]
        same = [v for v in near if v.nobj == c["nobj"]]
        claimed = scaled_score(c["trust"], c["conf"])
        by_name = c["shared"] or op["pinned"] or self.keep_all
        if same:
            stronger = any(claimed > scaled_score(v.net, v.conf) for v in same)
            action = "corroborate" if stronger else "duplicate"
            for v in same:
                self._support(v, c["source"], c["trust"], op, by_name=by_name or len(same) > 1,
                              reason=action + " source for same value")
            self._emit("decision", vid, branch=op["branch"], source=c["source"], other=same[0].vid,
                       reason=action)
            return

        if not cur:
            action, beaten = "add", []
        elif not near:
            action, beaten = "coexist", []
        elif op["hyp"]:
            action, beaten = "branch_override", near
        else:
            beaten = [v for v in near if self._is_newer(c, v) or self._at_least(claimed, v)]
            action = "supersede" if len(beaten) == len(near) else "unresolved_conflict"
        conflict = action == "unresolved_conflict"
        lost = {v.vid for v in beaten}

        new = Version(vid=vid, branch=op["branch"], hyp=op["hyp"],
                      status="hypothetical" if op["hyp"] else "active", obj=c["obj"], nobj=c["nobj"],
                      conf=c["conf"], vf=c["vf"], vt=c["vt"], source=c["source"], trust=c["trust"],
                      shared=c["shared"], prev=beaten[0].vid if beaten else None, conflict=conflict,
                      pinned=op["pinned"])
        self._emit("version", vid, branch=new.branch, source=new.source, status=new.status, other=new.prev,
                   reason=action, version=new)
        if "from" in c:
            self._emit("merged_from", vid, branch=op["target"], other=c["from"])
        self._support(new, c["source"], c["trust"], op, by_name=by_name, reason="introduced version")

        replaced: dict[int, tuple] = {}
        for v in near:
            if not (op["hyp"] and v.branch != op["branch"]):
                self._oppose(v, c["source"], c["trust"], op, by_name=by_name, other=vid)
            inherited = "superseded" if v.vid in lost else "active"
            if v.n_sup:
                self._emit("inherit", vid, branch=op["branch"], relation="opposition", status=inherited, other=v.vid,
                           reason="opposes existing version", n=v.n_sup, trust=v.sup)
            if inherited == "active":
                v.exact = True
                new.opp += v.sup
            backers = v.sup_by if v.supporters else {v.source: (v.trust, None)}
            seen = new.opp_by if inherited == "active" else replaced
            for source, (trust, _) in sorted(backers.items()):
                if source not in seen:
                    seen[source] = (trust, op["seq"])
                    self._emit("edge", vid, branch=op["branch"], source=source, relation="opposition", status=inherited,
                               other=v.vid, reason="opposes existing version", named=True, trust=trust)

        for v in cur:
            if conflict and v.branch == op["branch"] and not v.conflict:
                v.conflict = True
                self._emit("conflict", v.vid, branch=v.branch)
        if beaten and op["pinned"]:
            beaten[0].pinned = True  # a rollback may restore it, on whichever branch it lives
        for v in beaten:
            if v.branch == op["branch"]:
                self._set_status(v, "superseded", "superseded")
        self.live[vid] = new
        self.current.setdefault(new.branch, {})[vid] = new
        self._emit("decision", vid, branch=op["branch"], source=c["source"], other=new.prev, reason=action)

    @staticmethod
    def _is_newer(c, v: Version) -> bool:
        return c["vf"] is not None and (v.vf is None or c["vf"] >= v.vf)

    def _rollback(self, op):
        target = op["target"]
        for v in sorted((v for v in self.live.values() if v.vid >> ORD_BITS == target), key=lambda v: v.vid):
            if v.status != "retracted":
                self._end_all_edges(v, "rolled_back")
                self._set_status(v, "retracted", "rolled_back")
            prev = self.live.get(v.prev) if v.prev is not None else None
            if prev is None or prev.status != "superseded":
                continue
            held = any(w.prev == prev.vid and w.vid != v.vid
                       for w in self.current.get(prev.branch, {}).values())
            if not held:
                self._set_status(prev, "hypothetical" if prev.hyp else "active", "restored")
        for v in sorted(self.live.values(), key=lambda v: v.vid):
            lost_support = False
            for relation, named in (("support", v.sup_by), ("opposition", v.opp_by)):
                for source in [s for s, (_, seq) in named.items() if seq == target]:
                    del named[source]
                    lost_support = lost_support or relation == "support"
                    self._emit("end", v.vid, source=source, relation=relation, status="rolled_back")
            if lost_support and v.vid >> ORD_BITS != target and v.status in CURRENT and v.supporters == 0:
                self._set_status(v, "retracted", "support_rolled_back")

    # -- chunk summaries ------------------------------------------------
    def state(self) -> str:
        return json.dumps([self.live[vid].dump() for vid in sorted(self.live)])

    def emit_state(self):
        """The state as an event of kind ``state`` at the last operation's position."""
        self.events.append((self.key, "state", None, self._pos, self._k, *[None] * 6, self.state(), *[None] * 8))

    def summary(self) -> str:
        bounds = [[v.low, v.high, v.exact] for v in self.slots]
        return json.dumps({"in": self.incoming, "out": json.loads(self.state()), "bounds": bounds})


def _shape(raw: dict[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in raw.items() if k != "sums"}


def _net(raw: dict[str, Any]) -> int:
    named = sum(x[0] for x in raw["sup_by"].values()) - sum(x[0] for x in raw["opp_by"].values())
    return raw["sums"][0] - raw["sums"][2] + named


def _fits(state: list[dict], guess: list[dict], bounds: list[list]) -> bool:
    if len(state) != len(guess):
        return False
    for s, g, (low, high, exact) in zip(state, guess, bounds):
        if _shape(s) != _shape(g) or (exact and s["sums"] != g["sums"]):
            return False
        if (s["sums"][1] == 0) != (g["sums"][1] == 0):
            return False
        net = _net(s)
        if (low is not None and net < low) or (high is not None and net > high):
            return False
    return True


def _carry(state: list[dict], summary: dict) -> list[dict]:
    """State after a chunk, given the true (or best known) state before it.

    Exact whenever the summary fits ``state``.  Otherwise it is a guess that only
    decides how soon the rounds settle: versions of the same branch and object
    are taken to be the same version.
    """
    blind = not summary["in"]
    guess_by_id = {g["vid"]: g for g in summary["in"]}
    by_id = {s["vid"]: s for s in state}
    by_value = {(s["branch"], s["nobj"]): s for s in state}
    out: dict[int, dict] = {}
    only_known = True
    for o in summary["out"]:
        g = guess_by_id.get(o["vid"])
        known = by_id.get(o["vid"]) if g is not None else None
        if known is None and (g is not None or (blind and o["prev"] is None)):
            known = by_value.get((o["branch"], o["nobj"]))
        if known is not None:
            start = g or {"sums": [0, 0, 0], "sup_by": {}, "opp_by": {}}
            merged = {**o, **{name: known[name] for name in Version.PLAIN
                              if name not in ("status", "pinned", "conflict")}}
            merged["sums"] = [a + b - c for a, b, c in zip(known["sums"], o["sums"], start["sums"])]
            for field in ("sup_by", "opp_by"):
                gone = start[field].keys() - o[field].keys()
                merged[field] = {s: x for s, x in known[field].items() if s not in gone}
                merged[field].update({s: x for s, x in o[field].items() if start[field].get(s) != x})
            o = merged
        else:
            only_known = False
        out[o["vid"]] = o
    if blind and only_known:
        out = {**by_id, **out}
    return [out[vid] for vid in sorted(out)]


def chain(summaries: Iterable[tuple[int, str]]) -> Iterator[tuple[int, str, bool]]:
    """Thread the state through a key's chunk summaries in order.

    Yields ``(chunk, state before it, settled)``.  A chunk is settled when the
    states before it are certain and its own summary is valid for its start
    state; after the first unsettled chunk the states are best guesses.
    """
    state: list[dict] = []
    certain = True
    for chunk, text in summaries:
        summary = json.loads(text)
        certain = certain and _fits(state, summary["in"], summary["bounds"])
        yield chunk, json.dumps(state), certain
        state = _carry(state, summary)
