"""What several operators of this package share: tables, words, cut points of an order, workers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from claimweave.plans.session import scratch_dir, ship_package

#: ASCII-blank separated words, as the contracts of several queries define them.
WORD = r"[^\x20\x09-\x0D]+"
RUN = "__run"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: lineage is cut, and what it holds no longer changes on a retry."""
    spark = df.sparkSession
    scratch_dir(spark)  # names a folder where none is set
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
    return df.checkpoint()


class Scratch:
    """Intermediate tables of one job, written as Parquet in the shared folder and deleted as soon as nothing needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{scratch_dir(self.spark)}/claimweave/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        self._clean()
        return out

    def _clean(self) -> None:
        """Spark drops shuffle files of finished jobs when the driver's collector finds them unused, which may not run for long."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            _, path = self.paths.pop(id(table))
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self._clean()


def workers(df: DataFrame) -> DataFrame:
    """``df``, after making this package importable in the Python workers."""
    ship_package(df.sparkSession)
    return df


def text_of(column: str = "text") -> Column:
    """The text; a null is an empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (which are counted), else unchanged: then Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ordered_runs(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows range-partitioned by ``order`` with the number of their range; ranges follow each other in that order."""
    return kept(df.repartitionByRange(*[F.col(c) for c in order]).withColumn(RUN, F.spark_partition_id()))


def before_run(runs: DataFrame, group: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Per run and group, each sum over the group's earlier runs: one row per run and group, so small enough for windows.

    Columns: the group's, the run, ``<name>`` (sum inside) and ``<name>_before``.
    """
    inside = runs.groupBy(RUN, *group).agg(*[c.alias(n) for n, c in sums.items()])
    earlier = W.partitionBy(*group).orderBy(RUN).rowsBetween(W.unboundedPreceding, -1)
    return inside.select("*", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in sums])


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Equality of ``columns`` in which nulls equal each other."""
    on = F.lit(True)
    for c in columns:
        on = on & left[c].eqNullSafe(right[c])
    return on


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Adds exclusive prefix sums ``values`` (name -> integer column) over each group in ``order``.

    A group may be of any size: its rows lie in several ranges, windows work inside a range, and
    the sums of earlier ranges are added.
    """
    runs = ordered_runs(df.select("*", *[c.cast("long").alias(f"__{n}") for n, c in values.items()]), [*group, *order])
    offsets = before_run(runs, group, {f"__o_{n}": F.sum(f"__{n}") for n in values})
    offsets = offsets.select(*[F.col(c).alias(f"__g_{c}") for c in (*group, RUN)], *[f"__o_{n}_before" for n in values])
    local = W.partitionBy(RUN, *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inner = runs.select("*", *[F.coalesce(F.sum(f"__{n}").over(local), F.lit(0)).alias(f"__l_{n}") for n in values])
    on = F.lit(True)
    for c in (*group, RUN):
        on = on & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    out = inner.join(offsets, on)
    return out.select(*df.columns, *[(F.col(f"__l_{n}") + F.col(f"__o_{n}_before")).alias(n) for n in values])
