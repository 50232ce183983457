"""Order-dependent columns for groups that may be too large for one task.

A plain ``row_number() over (partition by key order by ts)`` puts a whole group into one
task.  Here rows are range-partitioned by (group, order) first, so a large group spans
several runs; the window works inside a run and a tiny per-run summary supplies what came
before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from claimweave.plans.session import materialise

RUN = "__run"


def range_runs(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with the number of the range partition they fell into (written, so it is stable)."""
    runs = df.repartitionByRange(*[F.col(c) for c in (*group, *order)])
    return materialise(runs.withColumn(RUN, F.spark_partition_id()), "runs")


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """1-based position of each row in its group, by ``order`` (unique within the group)."""
    runs = range_runs(df, group, order)
    before = W.partitionBy(*group).orderBy(RUN).rowsBetween(W.unboundedPreceding, -1) if group else (
        W.orderBy(RUN).rowsBetween(W.unboundedPreceding, -1))
    offsets = (
        runs.groupBy(RUN, *group).agg(F.count("*").alias("n"))
        .select(RUN, *group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    )
    local = F.row_number().over(W.partitionBy(RUN, *group).orderBy(*order))
    return (
        runs.withColumn("__local", local).join(offsets, [RUN, *group])
        .withColumn(name, (F.col("__local") + F.col("__offset")).cast("long"))
        .drop(RUN, "__local", "__offset")
    )


def with_previous(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``value`` of the row before, within the group."""
    runs = range_runs(df.withColumn("__value", value), group, order)
    last = runs.groupBy(RUN, *group).agg(F.max(F.struct(*order, "__value")).alias("__last"))
    carried = last.select(
        RUN, *group,
        F.lag("__last.__value").over(W.partitionBy(*group).orderBy(RUN)).alias("__carried"))
    local = F.lag("__value").over(W.partitionBy(RUN, *group).orderBy(*order))
    first = F.row_number().over(W.partitionBy(RUN, *group).orderBy(*order)) == 1
    return (
        runs.withColumn("__prev", local).withColumn("__first", first).join(carried, [RUN, *group])
        .withColumn(name, F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__prev")))
        .drop(RUN, "__value", "__prev", "__first", "__carried")
    )
