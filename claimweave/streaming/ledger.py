"""The ledger on a stream of operations, and the gate on a stream of proposals."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from claimweave.operators import checks as C
from claimweave.operators.increment import CONTROL, LedgerStore
from claimweave.plans.epochs import Epochs, columns
from claimweave.plans.session import materialise

DECISIONS = columns(staged_id="long", decision="string", overall_status="string", score="double", reason_summary="string")


def drain_ledger(operations: DataFrame, store: LedgerStore, checkpoint: str) -> LedgerStore:
    """Take what a stream of operations holds into ``store``, one epoch per micro-batch.

    ``operations``: the ledger's claim columns and, where ``op`` is not ``claim``, ``op`` and ``target`` of a rollback, retraction or merge.
    Operations may come in any order: late ones reopen the keys that they belong to. A repeated micro-batch counts
    once, as its number is its epoch. Claims the ledger cannot take are in ``store.rejected()`` with the reason.

    The state lies in the store's tables and not in the stream, because a rollback or merge has to be sent to all keys that its target
    wrote, which only the log knows.
    """
    def take(batch: DataFrame, epoch: int):
        batch = materialise(batch, "micro-batch")
        is_claim = F.coalesce(F.col("op"), F.lit("claim")) == "claim"
        control = batch.where(~is_claim).select(*[f.name for f in CONTROL.fields])
        store.apply(batch.where(is_claim), None if control.isEmpty() else control, epoch)

    q = operations.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return store


def as_operations(claims: DataFrame, control: DataFrame | None = None) -> DataFrame:
    """Claims and control operations as rows of one stream."""
    rows = claims.withColumn("op", F.lit("claim")).withColumn("target", F.lit(None).cast("long"))
    return rows if control is None else rows.unionByName(control, allowMissingColumns=True)


def stream_checks(staged: DataFrame, snapshot: C.Snapshot, path: str, checkpoint: str, *, today: str) -> DataFrame:
    """Run the gate on each micro-batch of proposals against the snapshot; returns the written decisions."""
    tables = Epochs(staged.sparkSession, path)

    def write(batch: DataFrame, epoch: int):
        _, decisions, _ = C.run_checks(C.check_input(materialise(batch, "proposals"), snapshot, today=today), written=True)
        tables.write("decisions", decisions.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DECISIONS.fields]), epoch)
        tables.commit(epoch)

    q = staged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return tables.read("decisions", DECISIONS).drop("epoch")


def drops(rows: DataFrame, order: str, path: str, parts: int = 3) -> Iterator[DataFrame]:
    """Write rows to ``path`` in ``parts`` successive slices of ``order``; after each, yield the folder as a stream.

    Draining the stream each time with the same checkpoint folder is how a scheduled job picks up
    what arrived since its last run.
    """
    spark = rows.sparkSession
    cuts = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)])).first()[0]
    for i in range(parts):
        part = rows
        if i > 0:
            part = part.where(F.col(order) > cuts[i - 1])
        if i < parts - 1:
            part = part.where(F.col(order) <= cuts[i])
        part.write.mode("append").parquet(path)
        yield spark.readStream.schema(rows.schema).parquet(path)
