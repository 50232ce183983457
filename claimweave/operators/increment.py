"""A ledger that takes its log in batches: only keys that a batch touches are read, folded and written.

For every key the store has the reducer's state after its last operation. A batch of later claims is folded from these
states. Some keys cannot go on from theirs and are *reopened*, that is folded anew from their own log, in order of commits:

* keys that get a claim from before their last operation, or from before a rollback or merge that would have reached it (late commits);
* keys that a rollback, retraction or merge of the batch reaches, since which of the older edges it needs was not known;
* keys under which a source turns up for the second time (from then on it is kept by name);
* keys with more operations in one batch than the fold takes in one chunk.

The result equals one fold of the whole log, whatever the batches and whatever order they come in. The state of a key grows
with its open versions and with the sources that return, not with its claims or batches.

Tables are split into buckets of keys, so a batch reads the buckets of its keys. Each batch is one epoch (``Epochs``): repeated or
killed in the middle, it counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimweave.operators import ledger as L
from claimweave.plans.epochs import Epochs, columns
from claimweave.plans.session import materialise, ship_package, sized_broadcast

CLAIMS = columns(claim_key="string", seq="long", ord="int", branch_id="long", source_id="long", trust_score="amount", object_value="string", normalized_object="string",
                 confidence="amount", valid_from="date", valid_to="date", bucket="int")
CONTROL = columns(seq="long", op="string", branch_id="long", target="long", claim_key="string")
STATES = columns(claim_key="string", last_pos="long", state="string", bucket="int")
RESETS = columns(claim_key="string")
REJECTED = columns(seq="long", ord="int", claim_key="string", branch_id="long", source_id="long", object_value="string", error="string")


class LedgerStore:
    """The written tables of one ledger and the operation that adds a batch to them."""

    def __init__(self, spark: SparkSession, path: str, branches: DataFrame, *, buckets: int = 64, full_states_every: int = 16,
                 options: L.FoldOptions | None = None):
        self.spark, self.branches, self.buckets, self.every = spark, branches, buckets, full_states_every
        self.options = options or L.FoldOptions()
        self.tables = Epochs(spark, path)

    # -- reading ---------------------------------------------------------
    def log(self) -> DataFrame:
        """All claims of the log."""
        return self.tables.read("log", CLAIMS)

    def control(self) -> DataFrame:
        return self.tables.read("control", CONTROL)

    def rejected(self) -> DataFrame:
        return self.tables.read("rejected", REJECTED)

    def states(self) -> DataFrame:
        """The last state of every key. Every ``full_states_every`` epochs all states are written, so older ones need no look."""
        full = [e for e in self.tables.committed() if e % self.every == self.every - 1]
        rows = self.tables.read("states", STATES, full[-1] if full else None)
        last = rows.groupBy("bucket", "claim_key").agg(F.max(F.struct("epoch", "last_pos", "state")).alias("s"))
        return last.select("claim_key", "s.last_pos", "s.state", "bucket")

    def events(self) -> DataFrame:
        """The events of the whole log as folded: of a reopened key those since it was reopened."""
        rows = self.tables.read("events", L.EVENT_SCHEMA)
        reset = self.tables.read("resets", RESETS).groupBy("claim_key").agg(F.max("epoch").alias("since"))
        return rows.join(sized_broadcast(reset), "claim_key", "left").where("since IS NULL OR epoch >= since").drop("since", "epoch")

    def ledger(self) -> L.Ledger:
        """The derived tables, as ``build_ledger`` has them."""
        return L.Ledger(materialise(self.events(), "events"), self.rejected)

    # -- adding a batch ----------------------------------------------------
    def _bucket(self):
        return F.pmod(F.xxhash64("claim_key"), F.lit(self.buckets)).cast("int")

    def _of_keys(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """Rows of some keys; only their buckets are scanned."""
        buckets = [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]  # at most as many as there are buckets
        return rows.where(F.col("bucket").isin(buckets)).join(sized_broadcast(keys), "claim_key", "left_semi")

    def _reached(self, control: DataFrame, every: DataFrame, log: DataFrame) -> DataFrame:
        """Keys that the given control operations reach; ``every``: all of them up to now."""
        ends = control.where("op = 'rollback'").agg(F.min("target"), F.max("target")).first()
        keys = control.where("op = 'retract'").select("claim_key")
        if ends[0] is not None:
            near = log.where(F.col("seq").between(*ends))  # rows of other commits are skipped by the files' ranges
            keys = keys.unionByName(near.join(sized_broadcast(control.where("op = 'rollback'").select(F.col("target").alias("seq")).distinct()), "seq", "left_semi").select("claim_key"))
        merges = control.where("op = 'merge'").select("seq").unionByName(control.where("op = 'rollback'").select(F.col("target").alias("seq")))
        feeding = L._merge_reach(every).join(merges.distinct(), "seq", "left_semi").select("branch_id").distinct()
        return keys.unionByName(log.join(sized_broadcast(feeding), "branch_id", "left_semi").select("claim_key")).distinct()

    def apply(self, claims: DataFrame, control: DataFrame | None = None, epoch: int | None = None) -> int:
        """Add a batch; returns its epoch. An epoch that is there already is left alone."""
        epoch = self.tables.next() if epoch is None else epoch
        if epoch in self.tables.committed():
            return epoch
        ship_package(self.spark)
        names = [f.name for f in CLAIMS.fields if f.name != "bucket"]
        good = claims.join(sized_broadcast(self.branches.select(F.col("id").alias("branch_id"))), "branch_id", "left_semi").where(L.claim_fault().isNull())
        rows = good.select(*[F.col(n).cast(CLAIMS[n].dataType).alias(n) for n in names]).withColumn("bucket", self._bucket())
        self.tables.write("log", rows, epoch, ["bucket"])
        self.tables.write("rejected", L.rejected_claims(claims, self.branches).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REJECTED.fields]), epoch)
        new = self.spark.read.schema(CLAIMS).parquet(f"{self.tables.path}/log/epoch={epoch}")
        old, before = self.log().drop("epoch"), self.control().drop("epoch")
        asked = None
        if control is not None:
            asked = materialise(control.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CONTROL.fields]), "asked")
            self.tables.write("control", asked, epoch)
        every = before if asked is None else before.unionByName(asked)

        keys = materialise(new.select("claim_key").distinct(), "keys")
        states = materialise(self._of_keys(self.states(), keys), "start-states")
        reopened = materialise(self._reopened(new, old, states, asked, before), "reopened")
        folded = self._fold_on(new.join(sized_broadcast(reopened), "claim_key", "left_anti"), states, old)
        if not reopened.isEmpty():
            whole = self._of_keys(old.unionByName(new.select(old.columns)), reopened)
            folded = folded.unionByName(L.fold_events(whole, self.branches, every if not every.isEmpty() else None, self.options, end_states=True))
        folded = materialise(folded, "folded")
        self.tables.write("events", folded.where("kind <> 'state'"), epoch)
        ends = folded.where("kind = 'state'").groupBy("claim_key").agg(F.max(F.struct("pos", "object_value")).alias("s"))
        ends = ends.select("claim_key", F.col("s.pos").alias("last_pos"), F.col("s.object_value").alias("state"), self._bucket().alias("bucket"))
        if epoch % self.every == self.every - 1:
            ends = ends.unionByName(self.states().join(ends.select("claim_key"), "claim_key", "left_anti").select(ends.columns))
        self.tables.write("states", ends, epoch, ["bucket"])
        self.tables.write("resets", reopened, epoch)
        self.tables.commit(epoch)
        return epoch

    def _reopened(self, new: DataFrame, old: DataFrame, states: DataFrame, asked: DataFrame | None, before: DataFrame) -> DataFrame:
        """Keys of the batch that cannot go on from their state."""
        first = new.groupBy("claim_key").agg(F.min(F.struct("seq", "ord")).alias("first"), F.count("*").alias("n"))
        pos = F.col("first.seq") * L.ORD_WIDTH + F.col("first.ord")
        stale = first.join(states.select("claim_key", "last_pos"), "claim_key", "left")
        keys = stale.where((pos <= F.col("last_pos")) | (F.col("n") > self.options.chunk_rows)).select("claim_key")
        if not before.isEmpty():
            undone = before.where("op = 'rollback'").select(F.col("target").alias("seq")).distinct()
            fed = L._merge_reach(before).groupBy("branch_id").agg(F.max("seq").alias("merged"))
            keys = keys.unionByName(new.join(sized_broadcast(undone), "seq", "left_semi").select("claim_key"))
            keys = keys.unionByName(new.join(sized_broadcast(fed), "branch_id").where("seq < merged").select("claim_key"))
        twice = self._earlier(new, old).where("n = 1").select("claim_key")
        keys = keys.unionByName(twice)
        if asked is not None:
            keys = keys.unionByName(self._reached(asked, before.unionByName(asked), old.unionByName(new.select(old.columns))))
        return keys.distinct()

    def _earlier(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """``claim_key, source_id, n``: how often sources of the batch had turned up under its keys before."""
        pairs = new.select("claim_key", "source_id").distinct()
        return self._of_keys(old, new.select("claim_key").distinct()).join(pairs, ["claim_key", "source_id"], "left_semi").groupBy("claim_key", "source_id").agg(F.count("*").alias("n"))

    def _fold_on(self, claims: DataFrame, states: DataFrame, old: DataFrame) -> DataFrame:
        """Events of claims that go on from the states of their keys."""
        ops = L.key_operations(claims, self.branches).withColumn("chunk", F.lit(0).cast("long"))
        known = self._earlier(claims, old).select("claim_key", "source_id", F.lit(True).alias("before"))
        ops = ops.join(known, ["claim_key", "source_id"], "left").withColumn("shared", F.col("shared") | F.coalesce("before", F.lit(False))).drop("before")
        start = states.join(claims.select("claim_key").distinct(), "claim_key", "left_semi").select("claim_key", F.lit(0).cast("long").alias("chunk"), "state")
        return L.run_fold(ops, start, self.options, end_states=True)
