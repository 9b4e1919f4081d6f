"""Streams over several micro-batches, with a restart, equal their batch twins."""

from __future__ import annotations

import datetime as dt
import os
import random
import tempfile

from pyspark.sql import functions as F

from chatlake.operators import limits as L
from chatlake.operators import state as S
from chatlake.sources import tables as T
from chatlake.streaming import streams as ST
from chatlake.streaming.limit_stream import LimitStream
from fixture_paths import SF001


def _split_events(spark, parts: int) -> str:
    """Write the events table as ``parts`` files in time order (one folder per test run)."""
    out = tempfile.mkdtemp(prefix="chatlake-events-")
    e = T.load(spark, SF001, "events")
    bounds = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    span = (bounds["b"] - bounds["a"]) / parts
    for i in range(parts):
        lo, hi = bounds["a"] + span * i, bounds["a"] + span * (i + 1)
        cond = (F.col("ts") >= lo) & ((F.col("ts") < hi) if i < parts - 1 else F.lit(True))
        e.where(cond).coalesce(1).write.parquet(f"{out}/part{i}")
        src = [f for f in os.listdir(f"{out}/part{i}") if f.endswith(".parquet")][0]
        os.rename(f"{out}/part{i}/{src}", f"{out}/events_{i:03d}.parquet")
    return out


def test_rate_limit_stream_multi_batch_restart(spark):
    path = _split_events(spark, 6)
    base = tempfile.mkdtemp(prefix="chatlake-rl3-")
    out, ck = f"{base}/out", f"{base}/ckpt"

    def run(limit_batches: int | None):
        sdf = T.load_stream(spark, path, "events", files_per_batch=1)
        q = (ST.rate_limit_stream(sdf, "user_id", "ts", "event_id", 86_400_000, 2)
             .writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()

    run(None)          # first run consumes all six files, one per batch
    run(None)          # restart from the checkpoint: nothing new, nothing duplicated
    got = {r["event_id"]: r["limited"] for r in spark.read.parquet(out).collect()}
    e = T.load(spark, SF001, "events")
    want = {r["event_id"]: r["limited"] for r in
            L.rate_limit(e, "user_id", "ts", 86_400_000, 2, tie="event_id").collect()}
    assert len(got) == len(want) and got == want


def test_feedback_stream_matches_batch(spark):
    path = _split_events(spark, 4)
    base = tempfile.mkdtemp(prefix="chatlake-sm2-")
    msgs = T.dream_messages(spark, SF001)

    def events():
        s = T.dream_messages_from(T.load_stream(spark, path, "events", files_per_batch=1))
        return T.feedback_events_from(s).withColumn(
            "ts", F.col("message_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("seq")))

    got = {r["message_id"]: r["feedback"] for r in ST.feedback_stream(events(), msgs, base=base).collect()}
    # a restarted query resumes from its checkpoint and the last snapshot
    again = {r["message_id"]: r["feedback"] for r in ST.feedback_stream(events(), msgs, base=base).collect()}
    ev = T.feedback_events(spark, SF001).withColumn(
        "ts", F.col("message_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("seq")))
    batch = S.latest_feedback(msgs, ev)
    touched = ev.join(msgs.where("role = 'ai'").select(F.col("id").alias("message_id"), "user_id"),
                      ["message_id", "user_id"], "left_semi").select("message_id").distinct()
    want = {r["id"]: r["feedback"] for r in batch.join(touched.withColumnRenamed("message_id", "id"), "id",
                                                       "left_semi").collect()}
    assert got == want
    assert again == want


def test_daily_counts_stream_multi_batch(spark):
    path = _split_events(spark, 5)
    msgs = T.dream_messages_from(T.load_stream(spark, path, "events", files_per_batch=1))
    res = ST.run_to_table(ST.daily_counts_stream(msgs), "sm1-test", mode="update", keys=["w"])
    got = {r["day"]: (r["ai_total"], r["up"], r["down"], r["none"], r["user_msgs"]) for r in
           res.select(F.to_date("w.start").alias("day"), "ai_total", "up", "down", "none", "user_msgs").collect()}
    b = T.dream_messages(spark, SF001)
    fb = F.col("feedback")
    ai = F.col("role") == "ai"
    want = {r["day"]: (r["a"], r["u"], r["d"], r["n"], r["m"]) for r in
            b.groupBy(F.to_date("created_at").alias("day")).agg(
                F.count_if(ai).alias("a"), F.count_if(ai & (fb == "up")).alias("u"),
                F.count_if(ai & (fb == "down")).alias("d"), F.count_if(ai & fb.isNull()).alias("n"),
                F.count_if(F.col("role") == "user").alias("m")).collect()}
    assert got == want

    dau = ST.run_to_table(ST.active_user_days_stream(
        T.dream_messages_from(T.load_stream(spark, path, "events", files_per_batch=1))), "sm1dau-test",
        mode="update", keys=["w", "user_id"])
    got = {r["day"]: r["c"] for r in dau.groupBy(F.to_date("w.start").alias("day"))
           .agg(F.count(F.lit(1)).alias("c")).collect()}
    want = {r["day"]: r["c"] for r in b.where("role = 'user'").groupBy(F.to_date("created_at").alias("day"))
            .agg(F.count_distinct("user_id").alias("c")).collect()}
    assert got == want


def test_signup_and_token_streams_multi_batch(spark):
    """SM1 over several micro-batches equals the batch counts; NULL totals count as 0."""
    path = _split_events(spark, 4)
    tokens = T.token_usage_from(T.load_stream(spark, path, "events", files_per_batch=1))
    res = ST.run_to_table(ST.daily_tokens_stream(tokens), "sm1tokens-test", mode="update", keys=["w"])
    got = {r["day"]: r["count"] for r in res.select(F.to_date("w.start").alias("day"), "count").collect()}
    want = {r["day"]: r["s"] or 0 for r in T.token_usage(spark, SF001).groupBy(F.to_date("created_at").alias("day"))
            .agg(F.sum("total_tokens").alias("s")).collect()}
    assert got == want
    users = T.users_from(T.load_stream(spark, SF001, "customer"))
    res = ST.run_to_table(ST.daily_signups_stream(users, "400 days"), "sm1signups-test", mode="update", keys=["w"])
    got = {r["day"]: r["count"] for r in res.select(F.to_date("w.start").alias("day"), "count").collect()}
    want = {r["day"]: r["count"] for r in
            T.users(spark, SF001).groupBy(F.to_date("created_at").alias("day")).count().collect()}
    assert got == want


def test_run_store_writes_grow_with_the_batch(spark, tmp_path):
    """30 batches: each writes its own rows and now and then a merge; every state equals the fold."""
    rng = random.Random(5)
    store = ST.feedback_store(spark, str(tmp_path / "runs"), fan=3, buckets=2)
    written, state = [], {}
    write = store._write
    store._write = lambda df, run: (write(df, run), written.append((run, spark.read.parquet(f"{store.path}/{run.name}").count())))
    for batch in range(12):
        rows = [(rng.randrange(40), rng.choice(["up", "down", None]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(600)),
                 100 * batch + i) for i in range(6)]
        for m, f, t, i in rows:
            state[m] = max(state.get(m, (t, i, f)), (t, i, f), key=lambda x: x[:2])
        store.write(spark.createDataFrame(rows, store.schema), batch)
    assert {r["message_id"]: r["feedback"] for r in store.read().collect()} == {m: f for m, (_, _, f) in state.items()}
    assert all(n <= 6 for run, n in written if run.level == 0)
    assert sum(n for _, n in written) <= 12 * 6 * 3           # once a level
    assert [r.name for r in store.live()] == ["0-9-9", "0-10-10", "0-11-11", "2-0-8"]
    parts = [store.read(b).count() for b in range(2)]
    assert sum(parts) == len(state)
    again = spark.createDataFrame([(99, "up", dt.datetime(2024, 2, 1), 1)], store.schema)
    before = len(written)
    store.write(again, 3)                                     # a retried batch that is merged already
    assert len(written) == before and store.read().where("message_id = 99").count() == 0
    store.write(again, 12, expired=F.col("message_id") < 20)   # merges 9 to 11 without their expired rows
    assert [r.name for r in store.live()] == ["0-12-12", "1-9-11", "2-0-8"]
    assert spark.read.parquet(f"{store.path}/1-9-11").where("message_id < 20").count() == 0
    store.write(again, 13)
    assert len(store.complete()) == len(store.live())         # dead runs are gone a batch later
    assert store.read(before=12).where("message_id = 99").count() == 0


def test_run_store_without_batches(spark, tmp_path):
    store = ST.feedback_store(spark, str(tmp_path / "none"))
    assert store.read().count() == 0 and store.live() == []


def _py_limits(events, window_s, most):
    state, out = {}, {}
    for key, t, i in sorted(events, key=lambda e: (e[0] or "", e[1], e[2])):
        s = state.setdefault(key, [t, 0])
        if (t - s[0]).total_seconds() > window_s:
            s[:] = [t, 0]
        out[i] = s[1] >= most
        s[1] += not out[i]
    return out


def test_limit_stream_batches_restart_and_late(spark, tmp_path):
    """Hot and NULL keys over batches in time order equal the fold; late events go to the side output."""
    rng = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    events = [(rng.choice(["hot"] * 6 + [None, "a", "b"]), t0 + dt.timedelta(seconds=rng.randrange(3600)), i) for i in range(600)]
    events.sort(key=lambda e: (e[1], e[2]))
    schema = "k string, ts timestamp_ntz, id long"
    stream = LimitStream(spark, "k", "ts", "id", 90_000, 3, str(tmp_path / "limits"), delay_ms=300_000)
    cuts = [events[i:i + 150] for i in range(0, 600, 150)]
    for i, part in enumerate(cuts):
        late = [("hot", t0 - dt.timedelta(hours=1), 1000 + i), ("hot", None, 2000 + i)] if i else []
        stream.step(spark.createDataFrame(part + late, schema), i)
        if i == 2:      # the same batch again, as after a failure, by a new driver
            stream = LimitStream(spark, "k", "ts", "id", 90_000, 3, stream.base, delay_ms=300_000)
            stream.step(spark.createDataFrame(part + late, schema), i)
    got = {r["id"]: r["limited"] for r in stream.limited().collect()}
    assert got == _py_limits(events, 90, 3)
    assert sorted(r["id"] for r in stream.late().collect()) == [1001, 1002, 1003, 2001, 2002, 2003]


def test_limit_stream_drops_states_that_are_over(spark, tmp_path):
    stream = LimitStream(spark, "k", "ts", "id", 60_000, 1, str(tmp_path / "limits"), delay_ms=60_000)
    stream.store.fan = 2
    t0 = dt.datetime(2024, 1, 1)
    for i in range(4):
        stream.step(spark.createDataFrame([(f"k{i}", t0 + dt.timedelta(hours=i), i)], "k string, ts timestamp_ntz, id long"), i)
    assert stream.store.read().count() < 4
    assert stream.limited().where("limited").count() == 0
