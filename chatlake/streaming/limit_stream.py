"""RL3 over hot keys: a stream of rate-limited events whose keys span tasks.

Every micro-batch is limited like a table (``rate_limit_from``): range-partitioned
by (key, time), with the keys' window states of the batches before it as first
rows, so a key that holds a third of a batch is spread over tasks.  The states
are kept as runs (``RunStore``): a batch writes those of its own keys, and states
whose window is over by the watermark are dropped when runs merge.

The watermark is the largest time of the batches before, less the delay.  Events
before it (and events without a time) are not limited: they go to a side output,
whole.  Outputs, states and marks are written under the batch's id, the mark
last, so a batch that is run again after a failure writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.operators.limits import rate_limit_from
from chatlake.streaming.run_store import RunStore
from chatlake.streaming.streams import batches, stream_dir

STATES = T.StructType([T.StructField("k", T.StringType())]
                      + [T.StructField(c, T.LongType()) for c in ("a", "b", "start", "count", "batch")])


def _micros(ts: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{ts}`)")


class LimitStream:
    """Limited and late events below one folder."""

    def __init__(self, spark: SparkSession, key: str, ts: str, tie: str, window_ms: int, max_count: int,
                 base: str | None = None, delay_ms: int = 600_000) -> None:
        self.spark, self.base = spark, base or stream_dir(spark, "limits")
        self.key, self.ts, self.tie = key, ts, tie
        self.window_ms, self.max_count, self.delay_us = window_ms, max_count, delay_ms * 1000
        self.store = RunStore(spark, f"{self.base}/states", STATES, "k", ["batch", "start", "count"])

    def watermark(self, batch_id: int) -> int | None:
        """Microseconds before which events are late (one small row for each batch is read)."""
        done = [f"{self.base}/marks/batch={i}" for i in batches(self.spark, f"{self.base}/marks") if i < batch_id]
        last = self.spark.read.schema("last long").parquet(*done).agg(F.max("last")).first()[0] if done else None
        return None if last is None else last - self.delay_us

    def step(self, df: DataFrame, batch_id: int) -> None:
        """One micro-batch."""
        at, mark = _micros(self.ts), self.watermark(batch_id)
        df = df.persist()
        late = at.isNull() | (F.lit(False) if mark is None else at < F.lit(mark))
        df.where(late).write.mode("overwrite").parquet(f"{self.base}/late/batch={batch_id}")
        states = self.store.read(before=batch_id).select("a", "b", "start", "count") if self.store.live() else None
        path = f"{self.base}/out/batch={batch_id}"
        (rate_limit_from(df.where(~late), self.key, self.ts, self.window_ms, self.max_count, self.tie, states)
         .write.mode("overwrite").parquet(path))
        # Starts and, within a window, counts only grow: the largest state is the last.
        after = (self.spark.read.parquet(path).groupBy("a", "b").agg(F.max(F.struct("start", "count")).alias("s"))
                 .select(F.concat_ws(":", "a", "b").alias("k"), "a", "b", "s.start", "s.count",
                         F.lit(batch_id).cast("long").alias("batch")))
        over = None if mark is None else F.col("start") + self.window_ms * 1000 < F.lit(mark)
        self.store.write(after, batch_id, expired=over)
        df.agg(F.max(at).alias("last")).write.mode("overwrite").parquet(f"{self.base}/marks/batch={batch_id}")
        df.unpersist()

    def run(self, sdf: DataFrame) -> None:
        """Drive a streaming DataFrame over all available input."""
        (sdf.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.base}/ckpt")
         .trigger(availableNow=True).start().awaitTermination())

    def limited(self) -> DataFrame:
        """All events so far with ``limited``."""
        done = batches(self.spark, f"{self.base}/out")
        out = self.spark.read.parquet(*[f"{self.base}/out/batch={i}" for i in done])
        return out.select("_row.*", "limited")

    def late(self) -> DataFrame:
        """The side output: events that came after the watermark had passed them."""
        return self.spark.read.parquet(*[f"{self.base}/late/batch={i}" for i in batches(self.spark, f"{self.base}/late")])
