"""Structured Streaming twins of RL1 (rate limits), AG4-AG7 (daily counts) and FB1 (feedback).

* RL3: ``applyInPandasWithState`` keyed by the limit key; state = (window
  start, count); events of one micro-batch are folded in (ts, id) order; an
  event-time timeout drops a key's state once the watermark passes
  start + 300 s (the application's sweep; no effect for windows <= 300 s).
* SM1: tumbling one-day windows with a watermark, update mode.  Daily
  distinct users come from a (day, user) keyed aggregation: the sink holds
  one row per active (day, user), and DAU is a count over it.
* SM2: ``foreachBatch`` upsert of the latest valid feedback per message into a
  table of runs under the checkpoint folder; a batch writes its own rows, keyed
  by batch id, so a retried batch rewrites the same run.

Checkpoints live under the session's ``spark.checkpoint.dir`` (shared storage
on a cluster), so a lost executor or a restarted driver resumes from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from chatlake.operators.limits import fold_windows
from chatlake.session import checkpoint_dir
from chatlake.streaming.run_store import RunStore

SWEEP_MS = 300_000


def stream_dir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex[:8]}"


def rate_limit_stream(sdf: DataFrame, key: str, ts: str, tie: str, window_ms: int, max_count: int,
                      watermark: str = "10 minutes") -> DataFrame:
    """RL3: RL1 on a stream.  Output: (tie, key, ts, limited) per event."""
    w_us = window_ms * 1000
    x = (sdf.select(F.col(key).alias("k"), F.col(ts).cast(T.TimestampType()).alias("ts"), F.col(tie).alias("id"))
            .withWatermark("ts", watermark))

    def fold(k, pdfs: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        start, count = (state.get if state.exists else (None, 0))
        parts = [p for p in pdfs if len(p)]
        if not parts:
            return
        pdf = pd.concat(parts).sort_values(["ts", "id"], kind="stable")
        t = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        limited = np.zeros(len(pdf), dtype=bool)
        start, count = fold_windows(t, start, count, w_us, max_count, limited)
        state.update((start, count))
        state.setTimeoutTimestamp(start // 1000 + max(SWEEP_MS, window_ms))
        yield pd.DataFrame({"id": pdf["id"].to_numpy(), "k": pdf["k"].to_numpy(), "ts": pdf["ts"].to_numpy(),
                            "limited": limited})

    out_schema = T.StructType([T.StructField("id", sdf.schema[tie].dataType),
                               T.StructField("k", sdf.schema[key].dataType),
                               T.StructField("ts", T.TimestampType()),
                               T.StructField("limited", T.BooleanType())])
    state_schema = "start long, count long"
    return (x.groupBy("k").applyInPandasWithState(fold, out_schema, state_schema, "append",
                                                  GroupStateTimeout.EventTimeTimeout)
             .withColumnRenamed("id", tie).withColumnRenamed("k", key))


def daily_counts_stream(msgs: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """SM1: per-day AI-message counts (total/up/down/none) and user-message counts."""
    fb = F.col("feedback")
    ai = F.col("role") == "ai"
    return (msgs.withColumn("ts", F.col("created_at").cast(T.TimestampType()))
                .withWatermark("ts", watermark)
                .groupBy(F.window("ts", "1 day").alias("w"))
                .agg(F.count_if(ai).alias("ai_total"), F.count_if(ai & (fb == "up")).alias("up"),
                     F.count_if(ai & (fb == "down")).alias("down"), F.count_if(ai & fb.isNull()).alias("none"),
                     F.count_if(F.col("role") == "user").alias("user_msgs")))


def daily_signups_stream(users: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """SM1 (AG4): signups per day."""
    return (users.withColumn("ts", F.col("created_at").cast(T.TimestampType()))
                 .withWatermark("ts", watermark)
                 .groupBy(F.window("ts", "1 day").alias("w"))
                 .agg(F.count(F.lit(1)).alias("count")))


def daily_tokens_stream(tokens: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """SM1 (AG6): token sum per day, 0 where every total is NULL."""
    return (tokens.withColumn("ts", F.col("created_at").cast(T.TimestampType()))
                  .withWatermark("ts", watermark)
                  .groupBy(F.window("ts", "1 day").alias("w"))
                  .agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("bigint").alias("count")))


def active_user_days_stream(msgs: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """SM1 (DAU): one row per (day, user) with a user message; DAU = rows per day."""
    return (msgs.where(F.col("role") == "user")
                .withColumn("ts", F.col("created_at").cast(T.TimestampType()))
                .withWatermark("ts", watermark)
                .groupBy(F.window("ts", "1 day").alias("w"), "user_id")
                .agg(F.count(F.lit(1)).alias("n")))


def batches(spark: SparkSession, folder: str) -> list[int]:
    """Ids of the completely written ``batch=N`` folders; an unreadable store raises."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return [int(p.getName().removeprefix("batch=")) for p in found if p.getName().startswith("batch=")
            and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def run_to_table(sdf: DataFrame, name: str, mode: str = "update", keys: list[str] | None = None) -> DataFrame:
    """Drive a streaming DataFrame over all available input into a parquet table; return it.

    ``update`` mode writes every changed row per batch; the result keeps the
    last version of each key (by batch id), so it is the final state.
    """
    spark = sdf.sparkSession
    base = stream_dir(spark, name)
    out = f"{base}/out"

    def sink(df: DataFrame, batch_id: int) -> None:
        df.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (sdf.writeStream.outputMode(mode).foreachBatch(sink)
            .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    if not batches(spark, out):  # no batch produced rows
        return spark.createDataFrame([], sdf.schema.add("_batch", T.LongType()))
    res = spark.read.parquet(out)
    if keys:
        from pyspark.sql import Window
        w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
        res = res.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return res.drop("_batch", "batch")


def feedback_stream(events: DataFrame, msgs: DataFrame, name: str = "feedback",
                    base: str | None = None) -> DataFrame:
    """SM2: stream feedback events into a per-message latest-feedback table; return the final table.

    Each micro-batch keeps only valid, owned events (JN4) and writes the latest
    of each message by (ts, id) as a run of its own; runs merge geometrically and
    readers merge what is live (``RunStore``), so what a batch writes grows with
    the batch, not with the table, and out-of-order batches still converge.
    """
    spark = events.sparkSession
    base = base or stream_dir(spark, name)
    own = msgs.where(F.col("role") == "ai").select(F.col("id").alias("message_id"), "user_id")
    store = feedback_store(spark, f"{base}/runs")

    def upsert(df: DataFrame, batch_id: int) -> None:
        store.write(df.where(F.col("feedback").isNull() | F.col("feedback").isin("up", "down"))
                    .join(own, ["message_id", "user_id"], "left_semi"), batch_id)

    q = (events.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{base}/ckpt")
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return store.read().select("message_id", "feedback")


def feedback_store(spark: SparkSession, path: str, **how) -> RunStore:
    """The table behind SM2."""
    schema = T.StructType([T.StructField("message_id", T.LongType()), T.StructField("feedback", T.StringType()),
                           T.StructField("ts", T.TimestampNTZType()), T.StructField("id", T.LongType())])
    return RunStore(spark, path, schema, "message_id", ["ts", "id"], **how)
