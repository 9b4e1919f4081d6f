"""Abuse control: anchored-window rate limits, rolling send counts, OTP outcomes.

RL1 windows are anchored at their first event (not clock-aligned) and a
limited event does not move the window, so window starts form a chain that
depends on the previous window: an ordered fold per key.  The events are range
partitioned by (key, ts, id), whatever the keys' sizes; the fold runs in
``mapInArrow`` with O(1) state, entered with the window state that a scan over
the partitions' step functions (``window_scan``) gives.  Each Python iteration
handles a whole window (``searchsorted`` finds its end), so the cost is per
window, not per event.

OT1 rolling counts are windows over (key, 15-minute bucket) with the previous
bucket duplicated in as context, so a hot e-mail or IP is split by time
rather than landing in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.functions.scalars import code_hash
from chatlake.functions.semantics import col_
from chatlake.operators import window_scan
from chatlake.session import checkpoint_dir

US_PER_MS = 1000


def _to_us(s: pd.Series) -> np.ndarray:
    return s.to_numpy().astype("datetime64[us]").astype(np.int64)


def fold_windows(t: np.ndarray, start, count: int, window_us: int, max_count: int,
                 limited: np.ndarray) -> tuple:
    """Fold one key's sorted event times (µs) from state (start, count); marks ``limited`` in place.

    One iteration per window: ``searchsorted`` finds where the window ends,
    the first ``max - count`` events in it pass, the rest are limited.
    Returns the state after the last event.
    """
    i, n = 0, len(t)
    while i < n:
        if start is None or t[i] - start > window_us:
            start, count = int(t[i]), 0
        j = int(np.searchsorted(t, start + window_us, side="right"))
        take = min(max(0, max_count - count), j - i)
        limited[i + take:j] = True
        count += take
        i = j
    return start, count


#: Names of the key digest (two 64-bit hashes), of the event time in microseconds and of the range partition.
_DIGEST = ("_rl_key_a", "_rl_key_b")
_TIME = "_rl_us"
_PART = "_rl_part"


def key_digest(group: list[str]) -> list[Column]:
    """128 bits that stand for a key of any type; NULL keys are one key of their own."""
    parts = [x for g in group for x in (col_(g).isNull(), col_(g))]
    return [F.xxhash64(F.lit(salt), *parts).alias(name) for salt, name in enumerate(_DIGEST)]


def _rate_fold(window_us: int, max_count: int, carried: dict):
    """Fold sorted Arrow batches from the partition's carried-in state; every input column passes through untouched."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cur, start, count, begun = None, None, 0, False
        for batch in it:
            n = len(batch)
            if n == 0:
                continue
            if not begun:
                begun = True
                cur, start, count = carried.get(batch[_PART][0].as_py(), (None, None, 0))
            a, b = (batch[c].to_numpy() for c in _DIGEST)
            t = batch[_TIME].to_numpy()
            limited = np.zeros(n, dtype=bool)
            change = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            bounds = np.concatenate(([0], np.flatnonzero(change) + 1, [n]))
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                k = (a[lo], b[lo])
                if k != cur:
                    cur, start, count = k, None, 0
                start, count = fold_windows(t[lo:hi], start, count, window_us, max_count, limited[lo:hi])
            keep = [c for c in batch.schema.names if c not in (*_DIGEST, _TIME, _PART)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(limited)], names=[*keep, "limited"])
    return run


def _micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{ts}`)")


def rate_limit(df: DataFrame, key: str, ts: str, window_ms: int, max_count: int,
               tie: str | None = None, partitions: int | None = None) -> DataFrame:
    """RL1: add ``limited`` per event, anchored windows per key.

    Per key, in (ts, tie) order: an event starts a new window (count 1) if
    there is none or ``ts - start > window`` (strict); else it is limited if
    count >= max (count and start unchanged); else count + 1.

    Events are range-partitioned by (key, ts, tie), so a key of any size, NULL
    included, spreads over partitions.  Every partition's effect on the window
    state is summed up as a step function, a scan over the functions gives the
    state at each partition's entry (``window_scan``), and each partition then
    folds its own events.  The sorted events are checkpointed, so that all
    passes see the same partitions.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    schema = T.StructType(df.schema.fields + [T.StructField("limited", T.BooleanType(), False)])
    # A total order, so a recomputed partition (lost executor) folds identically:
    # without an explicit tie column, every remaining column breaks ties.
    ties = [tie] if tie else [c for c in df.columns if c not in (key, ts)]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    window = window_ms * US_PER_MS
    order = [*_DIGEST, _TIME, *ties]
    sorted_ = (df.select("*", *key_digest([key]), _micros(ts).alias(_TIME)).repartitionByRange(n, *order)
               .sortWithinPartitions(*order).checkpoint(eager=True)
               .withColumn(_PART, F.spark_partition_id().cast("long")))
    functions = (sorted_.select(*_DIGEST, _TIME, _PART)
                 .mapInArrow(window_scan.summarise(window, max_count, _DIGEST, _TIME, _PART), window_scan.STEPS_DDL))
    if n > window_scan.FAN:
        functions = functions.checkpoint(eager=True)
    carried = window_scan.entries(functions, n, max_count)
    return sorted_.mapInArrow(_rate_fold(window, max_count, carried), schema)


_COUNT = "_rl_count"
STATE_DDL = "a long, b long, start long, count long"


def _fold_from_states(window_us: int, max_count: int, carried: dict):
    """As ``_rate_fold`` over rows in a struct: events with ``limited`` and the state after each; state rows go."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cur, start, count, begun = None, None, 0, False
        for batch in it:
            n = len(batch)
            if n == 0:
                continue
            if not begun:
                begun = True
                cur, start, count = carried.get(batch[_PART][0].as_py(), (None, None, 0))
            a, b = (batch[c].to_numpy() for c in _DIGEST)
            t, given = batch[_TIME].to_numpy(), batch[_COUNT].fill_null(-1).to_numpy()
            limited, starts, counts = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            bounds = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            for lo, hi in zip(bounds.tolist(), [*bounds[1:].tolist(), n]):
                if (a[lo], b[lo]) != cur:
                    cur, start, count = (a[lo], b[lo]), None, 0
                if given[lo] >= 0:
                    start, count, lo = int(t[lo]), int(given[lo]), lo + 1
                while lo < hi:      # a window at a time
                    if start is None or t[lo] - start > window_us:
                        start, count = int(t[lo]), 0
                    end = lo + int(np.searchsorted(t[lo:hi], start + window_us, side="right"))
                    seen = count + 1 + np.arange(end - lo)
                    limited[lo:end] = seen > max_count
                    starts[lo:end], counts[lo:end] = start, np.minimum(seen, max_count)
                    count, lo = int(counts[end - 1]), end
            keep = pa.array(np.flatnonzero(given < 0))
            columns = [batch["_row"], pa.array(limited), *(batch[c] for c in _DIGEST), pa.array(starts), pa.array(counts)]
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in columns],
                                             names=["_row", "limited", "a", "b", "start", "count"])
    return run


def rate_limit_from(df: DataFrame, key: str, ts: str, window_ms: int, max_count: int, tie: str,
                    states: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """RL1 that goes on from stored window states (STATE_DDL, by key digest), for a stream's next batch.

    A key's state is the first row of its events in the range partitioning, so no key is one task's here
    either.  Returns ``_row`` (the event), limited, and the state after the event: a, b, start, count.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    window = window_ms * US_PER_MS
    rows = df.select(F.struct("*").alias("_row"), *key_digest([key]), _micros(ts).alias(_TIME), F.col(tie).alias("_tie"),
                     F.lit(None).cast("long").alias(_COUNT))
    if states is not None:
        here = rows.select(F.col(_DIGEST[0]).alias("a"), F.col(_DIGEST[1]).alias("b")).distinct()
        known = states.join(here, ["a", "b"], "left_semi")
        types = {f.name: f.dataType for f in rows.schema}
        rows = rows.unionByName(known.select(
            F.lit(None).cast(types["_row"]).alias("_row"), F.col("a").alias(_DIGEST[0]), F.col("b").alias(_DIGEST[1]),
            F.col("start").alias(_TIME), F.lit(None).cast(types["_tie"]).alias("_tie"), F.col("count").alias(_COUNT)))
    order = [*map(F.col, _DIGEST), F.col(_COUNT).isNull(), F.col(_TIME), F.col("_tie")]
    sorted_ = (rows.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint(eager=True)
               .withColumn(_PART, F.spark_partition_id().cast("long")))
    functions = (sorted_.select(*_DIGEST, _TIME, _PART, _COUNT)
                 .mapInArrow(window_scan.summarise(window, max_count, _DIGEST, _TIME, _PART, _COUNT), window_scan.STEPS_DDL))
    if n > window_scan.FAN:
        functions = functions.checkpoint(eager=True)
    carried = window_scan.entries(functions, n, max_count)
    schema = T.StructType([sorted_.schema["_row"], T.StructField("limited", T.BooleanType()),
                           *[T.StructField(c, T.LongType()) for c in ("a", "b", "start", "count")]])
    return sorted_.mapInArrow(_fold_from_states(window, max_count, carried), schema)


# The chat request limits (per minute).
IP_LIMIT = (60_000, 15)
USER_LIMIT = (60_000, 20)


def rate_limit_chain(requests: DataFrame, ip: str = "ip", user: str = "user_id", ts: str = "ts",
                     tie: str = "request_id", ip_limit=IP_LIMIT, user_limit=USER_LIMIT) -> DataFrame:
    """RL2: ip limit first; only requests that pass it count against the user limit."""
    a = rate_limit(requests, ip, ts, ip_limit[0], ip_limit[1], tie).withColumnRenamed("limited", "ip_limited")
    passed = a.where(~F.col("ip_limited")).drop("ip_limited")
    b = rate_limit(passed, user, ts, user_limit[0], user_limit[1], tie).withColumnRenamed("limited", "user_limited")
    ip_hit = a.where(F.col("ip_limited")).drop("ip_limited").withColumn("limited", F.lit(True)) \
              .withColumn("by", F.lit("ip"))
    user_rows = b.withColumn("by", F.when(F.col("user_limited"), F.lit("user"))) \
                 .withColumnRenamed("user_limited", "limited")
    return ip_hit.unionByName(user_rows)


# ------------------------------------------------------------------ OT1

def rolling_counts(df: DataFrame, key: str, ts: str, window_minutes: int, tie: str = "id") -> DataFrame:
    """Count, per row, earlier rows of the same key with ``ts > ts_row - window`` (strict).

    Rows are bucketed by ``floor(ts / window)``; each row is also copied into
    the next bucket as context.  Windows partition by (key, bucket), so every
    partition spans at most two window lengths of one key.
    """
    w_us = window_minutes * 60 * 1_000_000
    us = _micros(ts)
    base = df.withColumn("_us", us).withColumn("_b", F.floor(F.col("_us") / w_us))
    own = base.withColumn("_own", F.lit(True))
    ctx = base.withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False))
    x = own.unionByName(ctx)
    w_rows = Window.partitionBy(key, "_b").orderBy("_us", tie)
    w_old = Window.partitionBy(key, "_b").orderBy("_us").rangeBetween(Window.unboundedPreceding, -w_us)
    x = (x.withColumn("_rn", F.row_number().over(w_rows))
          .withColumn("_old", F.count(F.lit(1)).over(w_old)))
    return (x.where("_own").withColumn("prior", (F.col("_rn") - 1 - F.col("_old")).cast("bigint"))
             .drop("_us", "_b", "_own", "_rn", "_old"))


def rolling_sends(log: DataFrame) -> DataFrame:
    """OT1: per send, earlier sends by e-mail in 15 min (limit 3) and by IP in 1 h (limit 10).

    The application deletes an address's earlier codes on each send, so its
    e-mail limit cannot trigger; this runs on the append-only send log.
    """
    e = rolling_counts(log, "email", "created_at", 15).withColumnRenamed("prior", "prior_email")
    i = rolling_counts(log.select("id", "ip", "created_at"), "ip", "created_at", 60) \
        .select("id", F.col("prior").alias("prior_ip"))
    j = e.join(i, "id")
    return j.withColumn("email_limited", F.col("prior_email") >= 3).withColumn("ip_limited", F.col("prior_ip") >= 10)


# ------------------------------------------------------------------ OT2

OTP_TTL_US = 10 * 60 * 1_000_000
OTP_MAX_ATTEMPTS = 5
# After at most this many valid attempts the code is gone (ok, expired or too many).
OTP_DECISIVE = OTP_MAX_ATTEMPTS + 1


def _otp_step(state, kind, t, hsh, fmt_ok):
    """One event of the OTP state machine: (state, event) -> (state, outcome).

    state = (code_hash or None, expires_us, attempts).
    """
    h, exp, att = state
    if kind == "send":
        return (hsh, t + OTP_TTL_US, 0), "sent"
    if hsh is None:
        return state, "missing"
    if not fmt_ok:
        return state, "bad_format"
    if h is None:
        return state, "no_code"
    if exp < t:
        return (None, exp, att), "expired"
    if att >= OTP_MAX_ATTEMPTS:
        return (None, exp, att), "too_many"
    if hsh != h:
        return (h, exp, att + 1), "incorrect"
    return (None, exp, att), "ok"


FRESH = (None, None, 0)


def _otp_rows(pdf: pd.DataFrame):
    return zip(pdf["email"].tolist(), pdf["kind"].tolist(), _to_us(pdf["ts"]).tolist(),
               pdf["code_hash"].tolist(), pdf["format_ok"].tolist())


def _otp_summary(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pass 1: per partition, what a carried-in state needs and the local end state.

    first run (the partition's first e-mail): whether it has a send, and its
    first ``OTP_DECISIVE`` valid attempts before that send (all a carried-in
    state can react to); last run: its end state from a fresh start (exact if
    the run has a send or began in this partition).
    """
    pid, first, last, has_send, pre, state = None, None, None, False, [], FRESH
    for pdf in it:
        if pdf.empty:
            continue
        pid = int(pdf["_pid"].iloc[0])
        for em, kind, t, hsh, ok in _otp_rows(pdf):
            if first is None:
                first = em
            if em != last:
                last, state = em, FRESH
            if em == first and not has_send:
                if kind == "send":
                    has_send = True
                elif hsh is not None and ok and len(pre) < OTP_DECISIVE:
                    pre.append((t, hsh))
            state, _ = _otp_step(state, kind, t, hsh, ok)
    if pid is None:
        return
    yield pd.DataFrame({"pid": [pid], "first": [first], "last": [last], "has_send": [has_send],
                        "pre_t": [[t for t, _ in pre]], "pre_h": [[h for _, h in pre]],
                        "end_h": [state[0]], "end_exp": [state[1]], "end_att": [state[2]]})


def _otp_carry(summaries: list) -> dict[int, tuple]:
    """Driver scan over partition summaries (one small row per partition) → carried-in state."""
    carry_in: dict[int, tuple] = {}
    email, state = None, FRESH
    for r in sorted(summaries, key=lambda r: r["pid"]):
        if r["first"] == email:
            carry_in[r["pid"]] = state
            start = state
        else:
            start = FRESH
        end_local = (r["end_h"], r["end_exp"], r["end_att"])
        if r["first"] == r["last"] and not r["has_send"]:
            st = start
            for t, h in zip(r["pre_t"], r["pre_h"]):
                st, _ = _otp_step(st, "attempt", t, h, True)
            state = st
        else:
            state = end_local
        email = r["last"]
    return carry_in


def _otp_fold(carry_in: dict[int, tuple]):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, state = None, FRESH
        for pdf in it:
            if pdf.empty:
                continue
            pid = int(pdf["_pid"].iloc[0])
            if cur is None and pid in carry_in:
                cur, state = pdf["email"].iloc[0], carry_in[pid]
            out = []
            for em, kind, t, hsh, ok in _otp_rows(pdf):
                if em != cur:
                    cur, state = em, FRESH
                state, o = _otp_step(state, kind, t, hsh, ok)
                out.append(o)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "outcome": out})
    return run


def otp_outcomes(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """OT2: outcome of every OTP send and verify attempt, in time order per e-mail.

    ``events``: id, email, ts, kind ('send' | 'attempt'), code.  Codes are
    hashed (SHA-256 hex) and format-checked in the JVM.  Codes live 10
    minutes, at most 5 wrong attempts, a new send replaces the code.

    Skew: events are range-partitioned by (email, ts, id), so a hot e-mail
    spans many partitions, and materialised once (reliable checkpoint) so both
    passes see the same partitions.  A carried-in state can only react to the
    next few valid attempts before the next send, so each partition ships one
    small summary row; the driver scans those rows (bounded by the partition
    count) and each partition then folds from its exact carry-in.
    Returns (id, outcome).
    """
    x = events.select("id", "email", "ts", "kind",
                      F.when(F.coalesce(F.col("code"), F.lit("")) != "", code_hash("code")).alias("code_hash"),
                      F.coalesce(col_("code").rlike(r"^[0-9]{6}\z"), F.lit(False)).alias("format_ok"))
    n = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    checkpoint_dir(events.sparkSession)
    srt = (x.repartitionByRange(n, "email", "ts", "id").sortWithinPartitions("email", "ts", "id")
            .checkpoint(eager=True).withColumn("_pid", F.spark_partition_id()))
    summary_schema = ("pid int, first string, last string, has_send boolean, pre_t array<long>, "
                      "pre_h array<string>, end_h string, end_exp long, end_att int")
    summaries = [r.asDict() for r in srt.mapInPandas(_otp_summary, summary_schema).collect()]
    return srt.mapInPandas(_otp_fold(_otp_carry(summaries)), "id long, outcome string")
