"""Rate limits and OTP outcomes against independent Python folds and hand-made cases."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from chatlake.operators import limits as L
from chatlake.operators import window_scan as S
from chatlake.sources import tables as T
from fixture_paths import SF01

T0 = dt.datetime(2024, 1, 1)


def py_rate_limit(events, window_ms, max_count):
    """Row-by-row fold, as the in-memory limiter does it (events sorted by key, ts, id)."""
    state, out = {}, {}
    for key, ts, i in sorted(events, key=lambda e: (e[0] or "", e[1], e[2])):
        s = state.get(key)
        now = ts
        if s is None or (now - s[0]) > dt.timedelta(milliseconds=window_ms):
            state[key] = [now, 1]
            out[i] = False
        elif s[1] >= max_count:
            out[i] = True
        else:
            s[1] += 1
            out[i] = False
    return out


def _run(spark, events, window_ms, max_count, partitions=None):
    df = spark.createDataFrame(events, "k string, ts timestamp_ntz, id long")
    res = L.rate_limit(df, "k", "ts", window_ms, max_count, tie="id", partitions=partitions)
    return {r["id"]: r["limited"] for r in res.collect()}


def test_rate_limit_edges(spark):
    ms = dt.timedelta(milliseconds=1)
    ev = [
        ("a", T0, 1), ("a", T0 + 60000 * ms, 2),            # gap exactly = window: same window
        ("a", T0 + 60000 * ms, 3),                          # equal times, over max=2 → limited
        ("a", T0 + 60001 * ms, 4),                          # one ms more than window → new window
        ("b", T0, 5), ("b", T0, 6), ("b", T0, 7), ("b", T0 + 10 * ms, 8),
    ]
    got = _run(spark, ev, 60000, 2)
    assert got == py_rate_limit(ev, 60000, 2)
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True, 8: True}


def test_rate_limit_random_against_fold(spark):
    rnd = random.Random(5)
    ev = []
    for i in range(3000):
        k = rnd.choice(["hot"] * 6 + ["a", "b", "c"])        # one key holds ~2/3 of the rows
        ev.append((k, T0 + dt.timedelta(milliseconds=rnd.randrange(0, 3_600_000)), i))
    # 3 partitions and many Arrow batches: state must carry across batch boundaries
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = _run(spark, ev, 30_000, 3, partitions=3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == py_rate_limit(ev, 30_000, 3)


def test_rate_limit_fixture_count(spark):
    e = T.load(spark, SF01, "events")
    n = L.rate_limit(e, "user_id", "ts", 86_400_000, 2, tie="event_id").where("limited").count()
    assert n == 4146


def test_chain_ip_limited_do_not_count_for_user(spark):
    s = dt.timedelta(seconds=1)
    rows = [(i, 7, "1.1.1.1", T0 + i * s) for i in range(16)]            # 16th is ip-limited
    rows += [(100 + i, 7, f"2.2.2.{i}", T0 + (20 + i) * s) for i in range(6)]
    df = spark.createDataFrame(rows, "request_id long, user_id long, ip string, ts timestamp_ntz")
    res = {r["request_id"]: (r["limited"], r["by"]) for r in L.rate_limit_chain(df).collect()}
    assert res[15] == (True, "ip")
    # user saw 15 + 6 = 21 requests; the ip-limited one does not count, so only the 21st passing is limited
    assert [res[100 + i][0] for i in range(6)] == [False, False, False, False, False, True]
    assert res[105] == (True, "user")


def _otp(spark, rows):
    df = spark.createDataFrame(rows, "id long, email string, ts timestamp_ntz, kind string, code string")
    return {r["id"]: r["outcome"] for r in L.otp_outcomes(df).collect()}


def test_otp_outcomes_hand_cases(spark):
    m = dt.timedelta(minutes=1)
    e = "a@x.io"
    rows = [
        (1, e, T0, "attempt", "123456"),                    # no code yet
        (2, e, T0 + m, "send", "111111"),
        (3, e, T0 + 2 * m, "attempt", "12345"),              # bad format, no state change
        (4, e, T0 + 2 * m, "attempt", "000000"),
        (5, e, T0 + 3 * m, "attempt", "000000"),
        (6, e, T0 + 3 * m, "attempt", "000000"),
        (7, e, T0 + 4 * m, "attempt", "000000"),
        (8, e, T0 + 4 * m, "attempt", "000000"),             # 5 wrong
        (9, e, T0 + 5 * m, "attempt", "111111"),             # 6th: too many (code removed)
        (10, e, T0 + 5 * m, "attempt", "111111"),            # nothing left
        (11, e, T0 + 6 * m, "send", "222222"),               # resend resets attempts
        (12, e, T0 + 7 * m, "attempt", "000000"),
        (13, e, T0 + 8 * m, "attempt", "222222"),            # ok
        (14, e, T0 + 9 * m, "send", "333333"),
        (15, e, T0 + 20 * m, "attempt", "333333"),           # 11 minutes later: expired
        (16, e, T0 + 21 * m, "attempt", None),               # missing code
    ]
    got = _otp(spark, rows)
    assert got == {1: "no_code", 2: "sent", 3: "bad_format", 4: "incorrect", 5: "incorrect", 6: "incorrect",
                   7: "incorrect", 8: "incorrect", 9: "too_many", 10: "no_code", 11: "sent", 12: "incorrect",
                   13: "ok", 14: "sent", 15: "expired", 16: "missing"}
    assert hashlib.sha256(b"111111").hexdigest()  # codes are compared as SHA-256 hex in the JVM


def test_rolling_sends_hot_email_split_by_time(spark):
    rows = [(i, "hot@x.io", "9.9.9.9", T0 + dt.timedelta(minutes=5 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, email string, ip string, created_at timestamp_ntz")
    res = {r["id"]: (r["prior_email"], r["prior_ip"]) for r in L.rolling_sends(df).collect()}
    # sends every 5 minutes: two earlier sends are strictly within 15 min, eleven within 1 h
    assert res[39] == (2, 11)
    assert res[0] == (0, 0) and res[1] == (1, 1)


def test_hot_key_bursts(spark):
    rnd = random.Random(11)
    ev, i = [], 0
    for burst in range(12):                                   # 12 bursts of the hot key, 2 h apart
        base = T0 + dt.timedelta(hours=2 * burst)
        for _ in range(300):
            ev.append(("hot", base + dt.timedelta(milliseconds=rnd.randrange(0, 600_000)), i))
            i += 1
    for k in range(40):                                       # many small keys
        for _ in range(5):
            ev.append((f"k{k}", T0 + dt.timedelta(seconds=rnd.randrange(0, 86_400)), i))
            i += 1
    for partitions in (1, 5, 40):
        assert _run(spark, ev, 60_000, 4, partitions) == py_rate_limit(ev, 60_000, 4)


def test_one_key_and_null_key_hold_all_rows(spark):
    """No task gets the key: its rows spread evenly, and the states still match the fold."""
    rnd = random.Random(12)
    for key in ("one", None):
        ev = [(key, T0 + dt.timedelta(milliseconds=rnd.randrange(0, 400_000)), i) for i in range(4000)]
        want = py_rate_limit(ev, 7_000, 3)
        df = spark.createDataFrame(ev, "k string, ts timestamp_ntz, id long")
        res = L.rate_limit(df, "k", "ts", 7_000, 3, tie="id", partitions=20)
        assert {r["id"]: r["limited"] for r in res.collect()} == want
        sizes = [r["count"] for r in res.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * 4000 / 20


def test_keys_of_any_type_and_repeated_rows(spark):
    s = dt.timedelta(seconds=1)
    rows = [(b"a", T0 + i * s, 1) for i in range(5)] + [(b"a", T0 + 4 * s, 1)] * 3 + [(b"b", T0, 2)]
    df = spark.createDataFrame(rows, "k binary, ts timestamp_ntz, id long")
    got = sorted((bytes(r["k"]), r["ts"], r["limited"]) for r in L.rate_limit(df, "k", "ts", 2_000, 2, partitions=4).collect())
    limited = [x[2] for x in got if x[0] == b"a"]
    assert len(got) == 9 and limited[:4] == [False, False, True, False] and sum(limited) == 4


def test_step_functions_equal_the_fold():
    """Any entry state through any cut of a key's events, composed in any grouping."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        n, window, most = int(rng.integers(1, 60)), int(rng.integers(1, 50)), int(rng.integers(1, 6))
        t = np.sort(rng.integers(100, 100 + int(rng.integers(1, 300)), n))
        cut = np.sort(rng.integers(0, n + 1, 3))
        parts = [p for p in np.split(t, cut) if p.size]
        functions = [S.steps_of((1, 2), p, window, most) for p in parts]
        whole = functions[0]
        for f in functions[1:]:
            whole = whole.then(f, most)
        for start in [None, *rng.integers(int(t[0]) - 2 * window, int(t[0]) + 1, 8).tolist()]:
            count = int(rng.integers(1, most + 1)) if start is not None else 0
            want = L.fold_windows(t, start, count, window, most, np.zeros(n, dtype=bool))
            entry = ((1, 2), start, count) if start is not None else (None, S.NONE, 0)
            state = entry
            for f in functions:
                state = f.leave(*state, most)
            assert state[1:] == want and whole.leave(*entry, most)[1:] == want


def py_otp(rows):
    """Independent row-by-row OTP fold over (id, email, ts, kind, code) rows."""
    out, st = {}, {}
    for i, em, ts, kind, code in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        h, exp, att = st.get(em, (None, None, 0))
        if kind == "send":
            st[em] = (code, ts + dt.timedelta(minutes=10), 0)
            out[i] = "sent"
        elif not code:
            out[i] = "missing"
        elif not (len(code) == 6 and code.isdigit()):
            out[i] = "bad_format"
        elif h is None:
            out[i] = "no_code"
        elif exp < ts:
            st[em] = (None, exp, att)
            out[i] = "expired"
        elif att >= 5:
            st[em] = (None, exp, att)
            out[i] = "too_many"
        elif code != h:
            st[em] = (h, exp, att + 1)
            out[i] = "incorrect"
        else:
            st[em] = (None, exp, att)
            out[i] = "ok"
    return out


def test_otp_hot_email_across_partitions(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(4000):
        em = "hot@x.io" if rnd.random() < 0.7 else f"u{rnd.randrange(30)}@x.io"
        ts = T0 + dt.timedelta(seconds=rnd.randrange(0, 6 * 3600))
        if rnd.random() < 0.08:
            rows.append((i, em, ts, "send", str(rnd.randrange(3))*6))
        else:
            r = rnd.random()
            code = str(rnd.randrange(3)) * 6 if r < 0.9 else ("12a456" if r < 0.95 else None)
            rows.append((i, em, ts, "attempt", code))
    df = spark.createDataFrame(rows, "id long, email string, ts timestamp_ntz, kind string, code string")
    got = {r["id"]: r["outcome"] for r in L.otp_outcomes(df, partitions=13).collect()}
    assert got == py_otp(rows)


def test_dense_keys_with_equal_times(spark):
    rnd = random.Random(21)
    ev = []
    for i in range(2500):
        k = rnd.choice(["hot"] * 8 + ["a", "b"])
        # coarse timestamps (100 ms grid) so equal times occur often
        ev.append((k, T0 + dt.timedelta(milliseconds=100 * rnd.randrange(0, 20_000)), i))
    for window_ms, mx, partitions in [(1_000, 3, 6), (60_000, 5, 20), (600_000, 40, 300), (10 ** 10, 7, 20)]:
        assert _run(spark, ev, window_ms, mx, partitions) == py_rate_limit(ev, window_ms, mx), (window_ms, mx)
