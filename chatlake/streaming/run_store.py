"""Latest row of each key, kept as sorted-out runs that merge geometrically.

A micro-batch writes one run that holds its own rows only (the latest of each
key), divided into buckets by key.  When FAN runs of a level are complete, they
merge into one run of the next level, so a row is rewritten once a level, not
once a batch.  A reader merges the few live runs; a bucket can be read alone.

Runs are folders ``level-first-last`` (of batch ids), written as a whole: only
those with a success mark count.  A run inside a larger complete one is dead; it
is deleted one batch later, so that readers of the moment finish.  A batch that is
run again writes the same folder, or nothing if a merged run holds it already.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN = 8
BUCKETS = 8


@dataclass(frozen=True, order=True)
class Run:
    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"{self.level}-{self.first}-{self.last}"

    def holds(self, other: Run) -> bool:
        return self.level > other.level and self.first <= other.first and other.last <= self.last


class RunStore:
    """``key`` (one column), and the columns that order its rows; the largest is the latest."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: list[str],
                 fan: int = FAN, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.key, self.order, self.fan, self.buckets = key, order, fan, buckets

    # ------------------------------------------------------------ folders

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def complete(self) -> list[Run]:
        """All runs with a success mark, dead ones too; an unreadable store raises."""
        root, fs = self._fs()
        if not fs.exists(root):
            return []
        new = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in fs.listStatus(root)]
        return sorted(Run(*map(int, p.getName().split("-"))) for p in found if fs.exists(new(p, "_SUCCESS")))

    def live(self) -> list[Run]:
        runs = self.complete()
        return [r for r in runs if not any(other.holds(r) for other in runs)]

    def _delete(self, runs: list[Run]) -> None:
        _, fs = self._fs()
        for r in runs:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{r.name}"), True)

    # ------------------------------------------------------------ rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _latest(self, df: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c != self.key]
        tie = [c for c in rest if c not in self.order]
        return (df.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.order, *tie)).alias("l"))
                .select(self.key, "l.*").select(*self.schema.names))

    def _rows(self, runs: list[Run]) -> DataFrame:
        out = self.spark.createDataFrame([], self.schema).withColumn("bucket", F.lit(0))
        for r in runs:
            out = out.unionByName(self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())]))
                                  .parquet(f"{self.path}/{r.name}"))
        return out

    def _write(self, df: DataFrame, run: Run) -> None:
        (df.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.path}/{run.name}"))

    def write(self, df: DataFrame, batch_id: int, expired: Column | None = None) -> None:
        """Merge the levels that earlier batches filled, then add this batch's rows.

        The run of a batch stays as it is until the next batch, so that a batch that is run again can still be
        read without it.  Rows that are ``expired`` are dropped when they are merged.
        """
        runs = self.complete()
        dead = [r for r in runs if any(other.holds(r) for other in runs)]
        level = 0
        while level <= max((r.level for r in runs), default=-1):
            full = [r for r in self.live() if r.level == level and r.last < batch_id]
            if len(full) >= self.fan:
                rows = self._latest(self._rows(full).drop("bucket"))
                rows = rows if expired is None else rows.where(~F.coalesce(expired, F.lit(False)))
                self._write(rows, Run(level + 1, full[0].first, full[-1].last))
                runs = self.complete()
            level += 1
        own = Run(0, batch_id, batch_id)
        if not any(r.holds(own) for r in runs):
            self._write(self._latest(df.select(*self.schema.names)), own)
        self._delete(dead)

    def read(self, bucket: int | None = None, before: int | None = None) -> DataFrame:
        """The latest row of each key (of one bucket, of the batches before one)."""
        rows = self._rows([r for r in self.live() if before is None or r.last < before])
        rows = rows if bucket is None else rows.where(F.col("bucket") == bucket)
        return self._latest(rows.drop("bucket"))
