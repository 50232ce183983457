"""The version ledger: operation log -> events -> versions and edges.

Input tables
    claims     claim_key, seq, ord, branch_id, source_id, trust_score, object_value,
               normalized_object, confidence, valid_from, valid_to
    branches   id, name, parent_branch_id
    control    seq, op ('rollback' | 'retract' | 'merge'), branch_id, target, claim_key
               (claim_key only for a retract; ``target`` is the commit rolled back, the
               version retracted or the branch merged)

``seq`` is the commit's place in the log and ``ord`` the claim's place in its commit.
A version is identified by its key and ``version_id`` = ``seq * 2**20 + ord`` of the
claim that introduced it, so ids rise in commit order without a global numbering pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from claimweave.functions.scores import exact
from claimweave.operators import fold
from claimweave.plans.ordered import numbered
from claimweave.plans.session import materialise, ship_package, sized_broadcast

ORD_WIDTH = 1 << fold.ORD_BITS

EVENT_SCHEMA = T.StructType([
    T.StructField("claim_key", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("version_id", T.LongType()),
    T.StructField("pos", T.LongType()),
    T.StructField("k", T.IntegerType()),
    T.StructField("branch_id", T.LongType()),
    T.StructField("source_id", T.LongType()),
    T.StructField("relation", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("other_id", T.LongType()),
    T.StructField("reason", T.StringType()),
    T.StructField("object_value", T.StringType()),
    T.StructField("normalized_object", T.StringType()),
    T.StructField("confidence", T.LongType()),
    T.StructField("valid_from", T.IntegerType()),
    T.StructField("valid_to", T.IntegerType()),
    T.StructField("conflict", T.BooleanType()),
    T.StructField("named", T.BooleanType()),
    T.StructField("n", T.LongType()),
    T.StructField("trust", T.LongType()),
])
_ARROW_EVENTS = pa.schema([
    ("claim_key", pa.string()), ("kind", pa.string()), ("version_id", pa.int64()), ("pos", pa.int64()),
    ("k", pa.int32()), ("branch_id", pa.int64()), ("source_id", pa.int64()), ("relation", pa.string()),
    ("status", pa.string()), ("other_id", pa.int64()), ("reason", pa.string()), ("object_value", pa.string()),
    ("normalized_object", pa.string()), ("confidence", pa.int64()), ("valid_from", pa.int32()),
    ("valid_to", pa.int32()), ("conflict", pa.bool_()), ("named", pa.bool_()), ("n", pa.int64()), ("trust", pa.int64()),
])
SUMMARY_SCHEMA = "claim_key string, chunk long, summary string"
_ARROW_SUMMARY = pa.schema([("claim_key", pa.string()), ("chunk", pa.int64()), ("summary", pa.string())])
STATE_SCHEMA = "claim_key string, chunk long, state string, settled boolean, turn long"
_ARROW_STATES = pa.schema([("claim_key", pa.string()), ("chunk", pa.int64()), ("state", pa.string()), ("settled", pa.bool_()), ("turn", pa.int64())])
#: Rows per Arrow batch of summaries and states.
STATE_ROWS = 5_000


@dataclass
class FoldOptions:
    """How the fold is cut up; results do not depend on it."""

    chunk_rows: int = 500_000
    """Operations of one key above which its history is folded in chunks."""
    batch_rows: int = 20_000
    """Event rows per Arrow batch handed back to Spark."""
    wide_rounds: int = 3
    """Rounds in which all unsettled chunks of a hot key are run."""
    window: int = 256
    """Unsettled chunks per hot key run in each later round."""


# ---------------------------------------------------------------------------
# Branch tree
# ---------------------------------------------------------------------------

def branch_ancestry(branches: DataFrame, viewers: DataFrame | None = None) -> DataFrame:
    """(branch_id, ancestor_id, depth), each branch being its own ancestor at depth 0; of all branches or of ``viewers`` (branch_id).

    Jump pointers double their reach from round to round, so a tree of any depth takes as many rounds as its logarithm.
    """
    start = branches.select(F.col("id").cast("long").alias("branch_id")) if viewers is None else viewers.select(F.col("branch_id").cast("long").alias("branch_id")).distinct()
    up = start.select("branch_id", F.col("branch_id").alias("ancestor_id"), F.lit(0).alias("depth"))
    jump = materialise(branches.where("parent_branch_id IS NOT NULL").select(F.col("id").cast("long").alias("at"), F.col("parent_branch_id").cast("long").alias("to")), "jumps")
    if viewers is not None:
        up = up.join(sized_broadcast(branches.select(F.col("id").cast("long").alias("branch_id"))), "branch_id", "left_semi")
    step = 1
    while not jump.isEmpty():
        further = up.join(sized_broadcast(jump), F.col("ancestor_id") == F.col("at")).select("branch_id", F.col("to").alias("ancestor_id"), (F.col("depth") + step).alias("depth"))
        up = materialise(up.unionByName(further), "ancestry")
        twice = jump.select(F.col("at").alias("from_id"), F.col("to").alias("at")).join(sized_broadcast(jump), "at")
        jump = materialise(twice.select(F.col("from_id").alias("at"), "to"), "jumps")
        step *= 2
    return up


def branches_after(branches: DataFrame, control: DataFrame) -> DataFrame:
    """The branch table with status ``merged`` for branches that a merge took over, and the first such commit."""
    merged = control.where("op = 'merge'").groupBy(F.col("target").cast("long").alias("id")).agg(F.min("seq").alias("merged_seq"))
    names = [F.col(c) for c in branches.columns if c != "status"]
    return branches.join(sized_broadcast(merged), "id", "left").select(*names, F.when(F.col("merged_seq").isNotNull(), "merged").otherwise(F.col("status")).alias("status"), "merged_seq")


def is_hypothetical(name, parent):
    """Everything but a parentless ``main`` is hypothetical."""
    return ~((name == F.lit("main")) & parent.isNull())


def branch_chains(branches: DataFrame) -> DataFrame:
    """One row per branch: its fallback chain ('3,2,1') and whether it is hypothetical."""
    chains = (
        branch_ancestry(branches)
        .groupBy("branch_id")
        .agg(F.array_sort(F.collect_list(F.struct("depth", "ancestor_id"))).alias("up"))
        .select("branch_id", F.concat_ws(",", F.transform("up", lambda x: x["ancestor_id"].cast("string"))).alias("chain"))
    )
    flags = branches.select(
        F.col("id").cast("long").alias("branch_id"),
        is_hypothetical(F.col("name"), F.col("parent_branch_id")).alias("hyp"),
    )
    return chains.join(flags, "branch_id")


# ---------------------------------------------------------------------------
# Operation stream per key
# ---------------------------------------------------------------------------

def _merge_reach(control: DataFrame) -> DataFrame:
    """(branch_id, merge seq): writes on ``branch_id`` may be read by that merge, directly or through earlier ones.

    Per branch and merge only the latest merge through which it is reached counts, since it admits all that earlier ones do.
    A round follows one merge further, so there are at most as many rounds as branches lie on a way.
    """
    merges = materialise(control.where("op = 'merge'").select("seq", F.col("branch_id").cast("long").alias("into"), F.col("target").cast("long").alias("branch_id")), "merges")
    reach = materialise(merges.select("branch_id", "seq", F.col("seq").alias("via")), "reach")
    fresh = reach
    while not fresh.isEmpty():
        earlier = merges.select("into", F.col("branch_id").alias("from_id"), F.col("seq").alias("at"))
        step = fresh.join(earlier, (F.col("into") == F.col("branch_id")) & (F.col("at") < F.col("via")))
        step = step.groupBy(F.col("from_id").alias("branch_id"), "seq").agg(F.max("at").alias("via"))
        better = step.join(reach.select("branch_id", "seq", F.col("via").alias("had")), ["branch_id", "seq"], "left").where("had IS NULL OR via > had")
        fresh = materialise(better.select("branch_id", "seq", "via"), "reach-step")
        reach = materialise(reach.unionByName(fresh).groupBy("branch_id", "seq").agg(F.max("via").alias("via")), "reach")
    return reach.select("branch_id", "seq")


#: Commits that are rolled back up to which their numbers are sent to all workers.
SENT_COMMITS = 500_000


def key_moves(claims: DataFrame, control: DataFrame) -> DataFrame:
    """Rollbacks, merges and retractions, each copied to the keys it reaches: ``claim_key, seq, op, branch_id, target``."""
    kinds = {r[0] for r in control.select("op").distinct().collect()}  # three at most
    head = control.select("seq", "op", F.col("branch_id").cast("long").alias("branch_id"), "target", F.col("claim_key").alias("own_key"))
    shown = ["claim_key", "seq", "op", "branch_id", "target"]
    writes = claims.where(claim_fault().isNull()).select("claim_key", "seq", F.col("branch_id").cast("long").alias("branch_id"))
    touched = writes.select("claim_key", "seq")
    moves = head.where("op = 'retract'").withColumn("claim_key", F.col("own_key")).select(*shown)
    if "merge" in kinds:
        merge_keys = writes.select("claim_key", "branch_id").distinct().join(_merge_reach(control), "branch_id").select("claim_key", "seq").distinct()
        merges = head.where("op = 'merge'").join(merge_keys, "seq").select(*shown)
        touched, moves = touched.unionByName(merges.select("claim_key", "seq")), moves.unionByName(merges)
    if "rollback" in kinds:
        back = head.where("op = 'rollback'")
        undone = touched.withColumnRenamed("seq", "target").join(sized_broadcast(back.select("target").distinct(), SENT_COMMITS), "target", "left_semi").distinct()
        moves = moves.unionByName(undone.join(sized_broadcast(back, SENT_COMMITS), "target").select(*shown))
    return moves


def key_operations(claims: DataFrame, branches: DataFrame, control: DataFrame | None = None) -> DataFrame:
    """The log as one ordered stream per claim key.

    A rollback is copied to the keys its target commit wrote, a merge to the keys
    that have writes on a branch feeding it.  Claims that ``rejected_claims`` lists are
    left out.  Branches are few, so they are broadcast (after counting them) and the claims
    are not shuffled by branch.
    """
    chains = sized_broadcast(branch_chains(branches))
    claims = claims.where(claim_fault().isNull())
    ops = claims.select(
        "claim_key", "seq", F.col("ord").cast("long").alias("ord"), F.lit("claim").alias("op"),
        F.col("branch_id").cast("long").alias("branch_id"), "source_id",
        exact(F.col("trust_score")).alias("trust"), "object_value", "normalized_object",
        exact(F.col("confidence")).alias("conf"),
        F.unix_date("valid_from").alias("vf"), F.unix_date("valid_to").alias("vt"),
        F.lit(None).cast("long").alias("target"),
    )
    pairs = claims.groupBy("claim_key", "source_id").count().where("count > 1")
    seen_again = sized_broadcast(materialise(pairs.select("claim_key", "source_id", F.lit(True).alias("again")), "seen-again"))
    ops = ops.join(seen_again, ["claim_key", "source_id"], "left").withColumn("shared", F.coalesce("again", F.lit(False))).drop("again")
    pinned = F.lit(False)
    if control is not None:
        kinds = {r[0] for r in control.select("op").distinct().collect()}  # three at most
        if "merge" in kinds:
            merged_from = sized_broadcast(_merge_reach(control).select("branch_id", F.lit(True).alias("feeds_merge")).distinct())
            ops = ops.join(merged_from, "branch_id", "left").withColumn("shared", F.col("shared") | F.coalesce("feeds_merge", F.lit(False))).drop("feeds_merge")
        blank = [F.lit(None).cast(t).alias(n) for n, t in (
            ("source_id", "long"), ("trust", "long"), ("object_value", "string"), ("normalized_object", "string"),
            ("conf", "long"), ("vf", "int"), ("vt", "int"))]
        moves = key_moves(claims, control).select("claim_key", "seq", F.lit(0).cast("long").alias("ord"), "op", "branch_id", "target", F.lit(True).alias("shared"), *blank)
        ops = ops.unionByName(moves.select(*ops.columns))
        if "rollback" in kinds:
            undone = control.where("op = 'rollback'").select(F.col("target").alias("seq"), F.lit(True).alias("p1")).distinct()
            ops = ops.join(sized_broadcast(undone, SENT_COMMITS), "seq", "left")
            pinned = F.coalesce("p1", pinned)
        if "retract" in kinds:
            retracted = control.where("op = 'retract'").select("claim_key", F.shiftright("target", fold.ORD_BITS).alias("seq"), F.lit(True).alias("p2")).distinct()
            ops = ops.join(sized_broadcast(retracted), ["claim_key", "seq"], "left")
            pinned = F.coalesce("p2", pinned)
    ops = ops.withColumn("pinned", pinned)
    fits = (F.col("ord") >= 0) & (F.col("ord") < ORD_WIDTH)
    pos = F.when(fits, F.col("seq") * ORD_WIDTH + F.col("ord")).otherwise(F.raise_error(F.lit("a commit holds at most 2^20 claims; split it")).cast("long"))
    return ops.join(chains, "branch_id").select(
        "claim_key", pos.alias("pos"), "op", "branch_id", "chain", "hyp",
        "source_id", "trust", "object_value", "normalized_object", "conf", "vf", "vt", "shared", "pinned", "target",
    )


def claim_fault() -> Column:
    """Why a claim cannot enter a ledger whatever its branch; null if it can."""
    def blank(name: str) -> Column:
        return F.coalesce(F.trim(F.col(name)), F.lit("")) == ""

    return (F.when(blank("claim_key"), "subject or predicate missing").when(blank("object_value"), "object missing")
            .when(F.col("seq").isNull(), "commit missing"))


def rejected_claims(claims: DataFrame, branches: DataFrame) -> DataFrame:
    """Claims the ledger cannot take, with the reason in ``error``: faulty in themselves, or on a branch that does not exist."""
    known = sized_broadcast(branches.select(F.col("id").cast("long").alias("branch_id"), F.lit(True).alias("known")))
    rows = claims.withColumn("branch_id", F.col("branch_id").cast("long")).join(known, "branch_id", "left")
    error = F.coalesce(claim_fault(), F.when(F.col("known").isNull(), "unknown branch"))
    return rows.withColumn("error", error).where("error IS NOT NULL").select(*claims.columns, "error")


# ---------------------------------------------------------------------------
# Running the reducer
# ---------------------------------------------------------------------------

_OP_COLUMNS = ["claim_key", "chunk", "pos", "op", "branch_id", "chain", "hyp", "source_id", "trust", "object_value",
               "normalized_object", "conf", "vf", "vt", "shared", "pinned", "target", "state"]


def _values(column: pa.Array) -> list:
    """Python values of a column; the usual cases (no nulls, only nulls) skip per-value conversion."""
    if column.null_count == len(column):
        return [None] * len(column)
    if column.null_count == 0:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _operations(batches) -> Iterator[tuple]:
    chains: dict[str, tuple[int, ...]] = {}
    for batch in batches:
        columns = [_values(batch.column(name)) for name in _OP_COLUMNS]
        for (key, chunk, pos, op, branch, chain, hyp, source, trust, obj, nobj, conf, vf, vt, shared, pinned,
             target, state) in zip(*columns):
            if chain is not None and chain not in chains:
                chains[chain] = tuple(int(x) for x in chain.split(","))
            yield key, chunk, state, {
                "pos": pos, "seq": pos >> fold.ORD_BITS if pos is not None else None, "op": op, "branch": branch,
                "chain": chains.get(chain, ()), "hyp": hyp, "source": source, "trust": trust, "obj": obj,
                "nobj": nobj, "conf": conf, "vf": vf, "vt": vt, "shared": shared, "pinned": pinned,
                "target": target}


def _event_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, type=field.type) for col, field in zip(zip(*rows), _ARROW_EVENTS)], schema=_ARROW_EVENTS)


def _fold_to_events(batch_rows: int, end_states: bool = False):
    def run(batches):
        unit, current, rows = None, None, []
        for key, chunk, state, op in _operations(batches):
            if (key, chunk) != unit:
                if end_states and current is not None:
                    current.emit_state()
                unit, current = (key, chunk), fold.KeyFold(key, state)
                current.events = rows
            if op["op"] == "state":
                continue
            current.apply(op)
            if len(rows) >= batch_rows:
                yield _event_batch(rows)
                rows.clear()
        if end_states and current is not None:
            current.emit_state()
        if rows:
            yield _event_batch(rows)
    return run


def _fold_to_summaries(batches):
    unit, current, out = None, None, []

    def pack():
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _ARROW_SUMMARY)], schema=_ARROW_SUMMARY)

    for key, chunk, state, op in _operations(batches):
        if (key, chunk) != unit:
            if unit is not None:
                out.append((*unit, current.summary()))
                if len(out) >= STATE_ROWS:
                    yield pack()
                    out.clear()
            unit, current = (key, chunk), fold.KeyFold(key, state, emit=False)
        if op["op"] != "state":
            current.apply(op)
    if unit is not None:
        out.append((*unit, current.summary()))
        yield pack()


def _chain_states(batches):
    """States before the chunks of each key; a key's summaries come together and in order."""
    def rows():
        for batch in batches:
            yield from zip(*[_values(batch.column(name)) for name in ("claim_key", "chunk", "summary")])

    out = []
    for key, group in groupby(rows(), key=lambda r: r[0]):
        turn = 0
        for chunk, state, settled in fold.chain((r[1], r[2]) for r in group):
            out.append((key, chunk, state, settled, turn))
            turn += not settled
            if len(out) >= STATE_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _ARROW_STATES)], schema=_ARROW_STATES)
                out.clear()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _ARROW_STATES)], schema=_ARROW_STATES)


def _ordered_units(ops: DataFrame, states: DataFrame | None) -> DataFrame:
    """Operations led by their chunk's start state, whole chunks together and in order."""
    rows = ops.withColumn("state", F.lit(None).cast("string"))
    if states is not None:
        lead = states.select("claim_key", "chunk", F.lit(-1).cast("long").alias("pos"), F.lit("state").alias("op"), "state")
        rows = rows.unionByName(lead, allowMissingColumns=True)
    return (
        rows.select(*_OP_COLUMNS)
        .repartition("claim_key", "chunk")
        .sortWithinPartitions("claim_key", "chunk", "pos")
    )


def hot_keys(ops: DataFrame, chunk_rows: int) -> DataFrame:
    """Keys with more than ``chunk_rows`` operations of any kind: a map-side combined count, at most rows / chunk_rows rows."""
    return ops.groupBy("claim_key").agg(F.count("*").alias("n")).where(F.col("n") > chunk_rows).select("claim_key")


def _assign_chunks(ops: DataFrame, hot: DataFrame | None, chunk_rows: int) -> DataFrame:
    """Chunk number of every operation: hot keys are cut every ``chunk_rows`` operations, however their positions bunch."""
    if hot is None:
        return ops.withColumn("chunk", F.lit(0).cast("long"))
    cold = ops.join(hot, "claim_key", "left_anti").withColumn("chunk", F.lit(0).cast("long"))
    ranked = numbered(ops.join(hot, "claim_key", "left_semi"), ["claim_key"], ["pos"], "rank")
    return cold.unionByName(ranked.withColumn("chunk", F.floor((F.col("rank") - 1) / chunk_rows).cast("long")).drop("rank"))


def settle_hot_chunks(ops: DataFrame, hot_keys: DataFrame, options: FoldOptions) -> DataFrame:
    """Start states (claim_key, chunk, state) for the chunks of the hot keys.

    Every round folds unsettled chunks in parallel from their best known start state, then
    threads states through the chunk summaries, one small row per chunk.  A round settles at
    least one more chunk per key, and usually all of them: what a chunk does rarely depends on
    more than which versions were current before it.  Where it does, later rounds work on the
    next ``window`` chunks only, as guesses further ahead would be redone anyway.
    """
    todo = materialise(ops.join(hot_keys, "claim_key", "left_semi"), "hot-ops")
    unit = ["claim_key", "chunk"]
    summaries = materialise(_ordered_units(todo, None).mapInArrow(_fold_to_summaries, SUMMARY_SCHEMA), "summaries")
    rounds = 1
    while True:
        chained = summaries.repartition("claim_key").sortWithinPartitions("claim_key", "chunk")
        states = materialise(chained.mapInArrow(_chain_states, STATE_SCHEMA), "states")
        unsettled = states.where(~F.col("settled"))
        if unsettled.isEmpty():
            return states.select(*unit, "state")
        rounds += 1
        again = unsettled if rounds <= options.wide_rounds else unsettled.where(F.col("turn") < options.window)
        work = _ordered_units(todo.join(again.select(*unit), unit, "left_semi"), again)
        fresh = work.mapInArrow(_fold_to_summaries, SUMMARY_SCHEMA)
        summaries = materialise(fresh.unionByName(summaries.join(again.select(*unit), unit, "left_anti")), "summaries")


def run_fold(ops: DataFrame, states: DataFrame | None, options: FoldOptions, end_states: bool = False) -> DataFrame:
    """Events of operations with their ``chunk``, folded from the chunks' start states (none: from nothing)."""
    return _ordered_units(ops, states).mapInArrow(_fold_to_events(options.batch_rows, end_states), EVENT_SCHEMA)


def fold_events(claims: DataFrame, branches: DataFrame, control: DataFrame | None = None,
                options: FoldOptions | None = None, end_states: bool = False) -> DataFrame:
    """Replay the operation log; the result is the event table all other tables derive from.

    With ``end_states`` each chunk's last row has the kind ``state`` and the reducer's state in ``object_value``.
    """
    options = options or FoldOptions()
    ship_package(claims.sparkSession)
    ops = key_operations(claims, branches, control)
    keys = claims.where(claim_fault().isNull()).select("claim_key")  # counted without the joins that operations need
    if control is not None:
        keys = keys.unionByName(key_moves(claims, control).select("claim_key"))
    hot = materialise(hot_keys(keys, options.chunk_rows), "hot-keys")
    states = None
    if hot.isEmpty():
        ops = _assign_chunks(ops, None, options.chunk_rows)
    else:
        ops = materialise(_assign_chunks(ops, hot, options.chunk_rows), "ops")
        states = settle_hot_chunks(ops, hot, options)
    return run_fold(ops, states, options, end_states)


# ---------------------------------------------------------------------------
# Tables derived from events
# ---------------------------------------------------------------------------

def versions_table(events: DataFrame) -> DataFrame:
    """One row per version with its final status.  One shuffle, map-side combined."""
    created = F.when(F.col("kind") == "version", F.struct(
        "pos", "branch_id", "source_id", F.col("other_id").alias("supersedes_id"), "object_value",
        "normalized_object", "confidence", "valid_from", "valid_to", F.col("reason").alias("action"), "conflict"))
    state = F.when(F.col("kind").isin("version", "status"), F.struct("pos", "k", "status", "reason"))
    rows = (
        events.where(F.col("kind").isin("version", "status", "conflict", "merged_from"))
        .groupBy("claim_key", "version_id")
        .agg(
            F.max(created).alias("v"),
            F.max(state).alias("s"),
            F.coalesce(F.bool_or(F.col("kind") == "conflict"), F.lit(False)).alias("late_conflict"),
            F.max(F.when(F.col("kind") == "merged_from", F.col("other_id"))).alias("merged_from_id"),
            F.coalesce(F.bool_or(F.col("reason").isin("rolled_back", "support_rolled_back")), F.lit(False)).alias("rolled_back"),
        )
    )
    return rows.select(
        "claim_key", "version_id",
        F.shiftright("v.pos", fold.ORD_BITS).alias("commit_seq"),
        F.col("v.branch_id").alias("branch_id"), F.col("v.source_id").alias("source_id"),
        F.col("v.supersedes_id").alias("supersedes_id"),
        F.col("v.object_value").alias("object_value"), F.col("v.normalized_object").alias("normalized_object"),
        (F.col("v.confidence") / fold.UNIT).cast("decimal(6,4)").alias("confidence"),
        F.date_from_unix_date("v.valid_from").alias("valid_from"), F.date_from_unix_date("v.valid_to").alias("valid_to"),
        F.col("s.status").alias("status"), F.col("v.action").alias("action"),
        F.when(F.col("v.conflict") | F.col("late_conflict"), F.concat(F.lit("conflict:"), "claim_key")).alias("conflict_group"),
        "merged_from_id", "rolled_back",
    )


def _with_end(edges: DataFrame, events: DataFrame, keyed: list[str]) -> DataFrame:
    """Add ``end`` (pos, status): the first event after an active edge was added that ended it."""
    ends_all = events.where("kind = 'end_all'").groupBy("claim_key", "version_id").agg(F.min(F.struct("pos", "status")).alias("end_all"))
    joined = edges.join(ends_all, ["claim_key", "version_id"], "left")
    own_end = F.lit(None)
    if "source_id" in edges.columns:
        ends_one = events.where("kind = 'end'").groupBy(*keyed).agg(F.array_sort(F.collect_list(F.struct("pos", "status"))).alias("ends"))
        joined = joined.join(ends_one, keyed, "left").withColumn("own_end", F.get(F.filter("ends", lambda x: x["pos"] > F.col("added_pos")), F.lit(0)))
        own_end = F.col("own_end")
    first = F.when(own_end.isNull() | (F.col("end_all.pos") < F.col("own_end.pos")), F.col("end_all")).otherwise(own_end) if "source_id" in edges.columns else F.col("end_all")
    return joined.withColumn("end", F.when(F.col("added_status") == "active", first)).drop("end_all", "ends", "own_end")


def _edge_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "claim_key", "version_id", "source_id", "relation",
        F.coalesce("end.status", "added_status").alias("status"),
        F.shiftright("added_pos", fold.ORD_BITS).alias("commit_seq"),
        F.shiftright("end.pos", fold.ORD_BITS).alias("removed_by_seq"),
        F.col("branch_id").alias("commit_branch_id"), "other_id", "reason", F.col("added_pos").alias("link_pos"), "named",
    )


def direct_links(events: DataFrame) -> DataFrame:
    """Edges the fold added one by one, with their final status: all support, and opposition by a claim's own source."""
    added = events.where("kind = 'edge'").select(
        "claim_key", "version_id", "source_id", "relation", F.col("status").alias("added_status"), F.col("pos").alias("added_pos"),
        "branch_id", "other_id", "reason", "named")
    return _edge_columns(_with_end(added, events, ["claim_key", "version_id", "source_id", "relation"]))


_EDGE_COLUMNS = ["claim_key", "kind", "version_id", "pos", "branch_id", "source_id", "relation", "status", "other_id", "reason", "named", "n", "trust"]
#: Versions up to which their ids are sent to all workers.
SENT_VERSIONS = 500_000


def edge_events(events: DataFrame, versions: DataFrame) -> DataFrame:
    """The events that make up the edges of some versions (``claim_key, version_id``), written: the rest need not be shuffled any further."""
    key = ["claim_key", "version_id"]
    rows = events.where(F.col("kind").isin("edge", "end", "end_all", "inherit")).select(*_EDGE_COLUMNS)
    return materialise(rows.join(sized_broadcast(versions.select(*key).distinct(), SENT_VERSIONS), key, "left_semi"), "edge-events")


def retracted_versions(events: DataFrame) -> DataFrame:
    """The retracted versions of ``versions_table``; only versions that a retraction or rollback reached are looked at."""
    key = ["claim_key", "version_id"]
    reached = events.where("kind IN ('version', 'status') AND status = 'retracted'").select(*key).distinct()
    return versions_table(events.join(sized_broadcast(reached, SENT_VERSIONS), key, "left_semi")).where("status = 'retracted'")


def rolled_back_links(events: DataFrame) -> DataFrame:
    """The direct edges that a rollback ended; only versions that it reached are looked at."""
    reached = events.where("kind IN ('end', 'end_all') AND status = 'rolled_back'").select("claim_key", "version_id")
    return direct_links(edge_events(events, reached)).where("status = 'rolled_back'")


def _inherits(events: DataFrame) -> DataFrame:
    rows = events.where("kind = 'inherit'").select(
        "claim_key", "version_id", "relation", F.col("status").alias("added_status"), F.col("pos").alias("added_pos"), "branch_id", "other_id", "reason",
        "n", "trust")
    return _with_end(rows, events, ["claim_key", "version_id"])


def inherited_totals(events: DataFrame) -> DataFrame:
    """Opposition a version took over from the supporters of the versions it opposed, as counts and trust sums (1e-4)."""
    return _inherits(events).select("claim_key", "version_id", "other_id", F.coalesce("end.status", "added_status").alias("status"), "n", "trust")


def links_table(events: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """Every support and opposition edge on its own: the direct ones and the inherited ones expanded.

    The expansion joins each opposing version with the supporters of the version it opposed.  Scores do
    not need it (see ``inherited_totals``).
    """
    direct = direct if direct is not None else direct_links(events)
    supporters = direct.where("relation = 'support' AND NOT named").select(
        "claim_key", F.col("version_id").alias("other_id"), "source_id", F.col("link_pos").alias("since"))
    expanded = _inherits(events).join(supporters, ["claim_key", "other_id"]).where("since < added_pos").withColumn("named", F.lit(False))
    return direct.unionByName(_edge_columns(expanded))


def decisions_table(events: DataFrame) -> DataFrame:
    """What the fold decided for each applied claim."""
    return events.where("kind = 'decision'").select(
        "claim_key", F.col("version_id").alias("claim_pos"), "branch_id", "source_id",
        F.col("reason").alias("action"), F.col("other_id").alias("related_id"))


class Ledger:
    """Outputs of one replay: the written events, and the tables derived from them, each written on first use."""

    def __init__(self, events: DataFrame, rejected: Callable[[], DataFrame]):
        self.events, self._rejected = events, rejected

    @cached_property
    def versions(self) -> DataFrame:
        return materialise(versions_table(self.events), "versions")

    @cached_property
    def direct(self) -> DataFrame:
        """Edges added one by one (``direct_links``)."""
        return materialise(direct_links(self.events), "direct-links")

    @cached_property
    def inherited(self) -> DataFrame:
        """Inherited opposition as sums (``inherited_totals``)."""
        return materialise(inherited_totals(self.events), "inherited")

    @cached_property
    def rejected(self) -> DataFrame:
        """Claims that could not enter, with the reason (``rejected_claims``)."""
        return self._rejected()

    @cached_property
    def links(self) -> DataFrame:
        """All edges one by one, expanded on first use."""
        return materialise(links_table(self.events, self.direct), "links")


def build_ledger(claims: DataFrame, branches: DataFrame, control: DataFrame | None = None,
                 options: FoldOptions | None = None) -> Ledger:
    """Fold once and write the events; what is derived from them is written when it is asked for."""
    events = materialise(fold_events(claims, branches, control, options), "events")
    return Ledger(events, lambda: materialise(rejected_claims(claims, branches), "rejected"))
