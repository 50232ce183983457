"""Tables that grow by numbered epochs, each of which counts wholly or not at all.

An epoch's rows are written to folders of their own (a repeated epoch replaces what it left), and a marker file
is created last. Readers look at marked epochs only, so a job that is killed between two tables, or repeated after it was
killed, leaves each row once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "date": T.DateType(), "amount": T.DecimalType(6, 4),
         "boolean": T.BooleanType()}


def columns(**kinds: str) -> T.StructType:
    """A schema from names and kinds (``amount`` is the decimal of trust and confidence), without a session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in kinds.items()])


class Epochs:
    """A folder of tables that share their epochs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._file = hadoop.Path
        self._fs = self._file(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._file(f"{self.path}/_epochs"))

    def committed(self) -> list[int]:
        """Marked epochs, ascending."""
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._file(f"{self.path}/_epochs")))

    def next(self) -> int:
        done = self.committed()
        return done[-1] + 1 if done else 0

    def write(self, name: str, df: DataFrame, epoch: int, partition_by: Sequence[str] = ()) -> None:
        """Rows of one table in one epoch; they are not seen before ``commit``."""
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/{name}/epoch={epoch}")

    def commit(self, epoch: int) -> None:
        self._fs.create(self._file(f"{self.path}/_epochs/{epoch}"), True).close()

    def read(self, name: str, schema: T.StructType, since: int | None = None) -> DataFrame:
        """Rows of the marked epochs with their ``epoch``, all or from ``since`` on."""
        there = [e for e in self.committed() if (since is None or e >= since) and self._fs.exists(self._file(f"{self.path}/{name}/epoch={e}"))]
        full = T.StructType([*schema.fields, T.StructField("epoch", T.IntegerType())])
        if not there:
            return self.spark.createDataFrame([], full)
        paths = [f"{self.path}/{name}/epoch={e}" for e in there]
        return self.spark.read.schema(full).option("basePath", f"{self.path}/{name}").parquet(*paths)
