"""State jobs: identity merge conflicts, admin actions, cascade delete, feedback toggles."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from chatlake.operators import state as S
from chatlake.sources import tables as T
from fixture_paths import SF001

T0 = dt.datetime(2024, 1, 30)

USERS = ("id long, login_source string, devonix_user_id long, first_name string, last_name string, "
         "email string, phone string, profile_picture string, plan string, banned boolean, ban_reason string, "
         "banned_at timestamp_ntz, suspended_until timestamp_ntz, suspend_reason string, "
         "last_login_at timestamp_ntz, created_at timestamp_ntz")


def _users(spark, rows):
    full = [(i, src, dev, "F", "L", em, "p", None, "free", banned, None, None, None, None, None, T0)
            for i, src, dev, em, banned in rows]
    return spark.createDataFrame(full, USERS)


def test_merge_identities_cases(spark):
    users = _users(spark, [
        (1, "devonix", 501, "a@x.io", False),
        (2, "email", None, "b@x.io", None),      # NULL banned is not banned
        (3, "devonix", 503, "c@x.io", True),     # banned, matched by id
        (4, "email", None, "d@x.io", True),      # banned, matched by e-mail
        (5, "email", None, "e@x.io", False),
    ])
    sso = spark.createDataFrame([
        (501, "", "New", "b@x.io", None, T0),     # by id, e-mail → owned by user 2 → conflict
        (502, "G", "H", "b@x.io", None, T0),      # by e-mail (user 2) → linked... but user 2's e-mail is in a conflict?
        (503, "I", "J", None, None, T0),          # banned by id
        (504, "K", "L", "d@x.io", None, T0),      # banned by e-mail
        (505, "M", "N", "new@x.io", None, T0),    # insert ...
        (506, "O", "P", "new@x.io", None, T0),    # ... two inserts with one e-mail → both conflicts
        (507, "Q", "R", None, None, T0),          # insert without e-mail
        (508, "S", "", "e@x.io", "123", T0),      # link to user 5, blank last name → NULL
    ], "devonix_user_id long, first_name string, last_name string, email string, phone string, ts timestamp_ntz")
    nxt, report = S.merge_identities(users, sso)
    out = {r["devonix_user_id"]: r["outcome"] for r in report.collect()}
    assert out == {501: "conflict", 502: "conflict", 503: "rejected", 504: "rejected", 505: "conflict",
                   506: "conflict", 507: "inserted", 508: "linked"}
    snap = {r["id"]: r for r in nxt.collect()}
    assert snap[5]["devonix_user_id"] == 508 and snap[5]["last_name"] is None and snap[5]["phone"] == "123"
    assert snap[5]["email"] == "e@x.io" and snap[5]["login_source"] == "email"
    assert snap[1]["first_name"] == "F"                     # conflict: unchanged
    assert snap[S.NEW_SSO_ID_BASE + 507]["login_source"] == "devonix"
    assert len(snap) == 6
    emails = [r["email"] for r in nxt.collect() if r["email"] is not None]
    assert len(emails) == len(set(emails))


def test_apply_actions_month_end_and_independence(spark):
    users = _users(spark, [(1, "email", None, "a", False), (2, "email", None, "b", False),
                           (3, "email", None, "c", False)])
    acts = spark.createDataFrame([
        (1, 1, "ban", "spam", 0, 0), (2, 1, "suspend", "", 1, 2), (3, 1, "unban", "x", 0, 0),
        (4, 2, "suspend", "r", 0, 0),                      # no duration → rejected
        (5, 3, "delete", "", 0, 0), (6, 3, "ban", "", 0, 0),
        (7, 99, "ban", "", 0, 0),                          # unknown id: audit row only
        (8, 2, "promote", "", 0, 0),                       # unknown action
    ], "seq long, target_id long, action string, reason string, months int, days int")
    nxt, audit, rejects = S.apply_actions(users, acts, "2024-01-31 10:00:00")
    snap = {r["id"]: r for r in nxt.collect()}
    assert set(snap) == {1, 2}
    assert snap[1]["banned"] is False and snap[1]["ban_reason"] is None and snap[1]["banned_at"] is None
    assert snap[1]["suspended_until"] == dt.datetime(2024, 3, 2, 10, 0)   # +1 month clamps to Feb 29, +2 days
    assert snap[1]["suspend_reason"] is None
    assert {r["seq"]: r["reject"] for r in rejects.collect()} == {4: "no_duration", 8: "unknown_action"}
    assert sorted(r["seq"] for r in audit.collect()) == [1, 2, 3, 5, 6, 7]


def test_cascade_delete_sets_null(spark):
    users = _users(spark, [(1, "email", None, "a", False), (2, "email", None, "b", False)])
    sessions = spark.createDataFrame([(10, 1), (20, 2)], "id long, user_id long")
    msgs = spark.createDataFrame([(100, 10, 1), (200, 20, 2), (201, 99, 2)], "id long, session_id long, user_id long")
    tokens = spark.createDataFrame([(1, 1, 100), (2, 2, 200), (3, 2, 201), (4, 2, None)],
                                   "id long, user_id long, message_id long")
    out = S.cascade_delete(users, sessions, msgs, tokens, spark.createDataFrame([(1,)], "id long"))
    assert [r["id"] for r in out["users"].collect()] == [2]
    assert sorted(r["id"] for r in out["dream_messages"].collect()) == [200]   # 201's session does not exist
    assert {r["id"]: r["message_id"] for r in out["token_usage"].collect()} == {2: 200, 3: None, 4: None}


def py_toggle(clicks):
    state = None
    for c in clicks:
        state = None if state == c else c
    return state


def test_toggle_feedback_against_fold(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for m in range(200):
        seq = [rnd.choice(["up", "down"]) for _ in range(rnd.randrange(1, 9))]
        want[m] = py_toggle(seq)
        rows += [(m, m * 100 + i, T0 + dt.timedelta(seconds=i), c) for i, c in enumerate(seq)]
    df = spark.createDataFrame(rows, "message_id long, id long, ts timestamp_ntz, click string")
    got = {r["message_id"]: r["feedback"] for r in S.toggle_feedback(df).collect()}
    assert got == want


def test_latest_feedback_ownership_and_clear(spark):
    msgs = spark.createDataFrame([(1, 7, "ai", "up"), (2, 7, "user", None), (3, 8, "ai", "down")],
                                 "id long, user_id long, role string, feedback string")
    ev = spark.createDataFrame([
        (1, 1, 7, None, T0), (2, 1, 7, "down", T0 - dt.timedelta(minutes=1)),   # later event clears
        (3, 2, 7, "up", T0),                                                     # not an AI message
        (4, 3, 9, "up", T0),                                                     # wrong owner
        (5, 3, 8, "meh", T0),                                                    # invalid value
    ], "id long, message_id long, user_id long, feedback string, ts timestamp_ntz")
    got = {r["id"]: r["feedback"] for r in S.latest_feedback(msgs, ev).collect()}
    assert got == {1: None, 2: None, 3: "down"}


def test_account_gate_order(spark):
    users = _users(spark, [(1, "email", None, "a", True), (2, "email", None, "b", False)])
    users = users.withColumn("suspended_until", F.when(F.col("id") == 2, F.lit(T0 + dt.timedelta(days=1))))
    req = spark.createDataFrame([
        (1, None, T0, "hello"), (2, 5, T0, "hello"), (3, 1, T0, "x"), (4, 2, T0, "hello"),
        (5, 2, T0 + dt.timedelta(days=2), " x "), (6, 2, T0 + dt.timedelta(days=2), "ok text")],
        "request_id long, user_id long, ts timestamp_ntz, text string")
    settings = T.app_settings(spark)
    got = {r["request_id"]: r["gate"] for r in S.account_gate(req, users, settings).collect()}
    assert got == {1: "no_account", 2: "no_account", 3: "banned", 4: "suspended", 5: "too_short", 6: "ok"}
    on = S.upsert_settings(settings, spark.createDataFrame([("maintenance_mode", "true", 1)],
                                                           "key string, value string, seq long"))
    got = {r["request_id"]: r["gate"] for r in S.account_gate(req, users, on).collect()}
    assert got[6] == "maintenance" and got[3] == "banned"


def test_fixture_views_have_all_outcomes(spark):
    _, report = S.merge_identities(T.users(spark, SF001), T.sso_payloads(spark, SF001))
    outcomes = {r["outcome"] for r in report.collect()}
    assert {"updated", "linked", "inserted", "rejected"} <= outcomes


def test_exchange_ids_do_not_collide(spark):
    """Many usage rows, several id steps and existing rows: new ids are new, dense and refer to each other."""
    usage = lambda n: [("m", i, 1, 0) for i in range(n)]
    ex = spark.createDataFrame([
        (5, 1, None, None, None, usage(30)), (6, 1, 77, "c", "e", usage(0)), (7, 2, None, "c", "e", None),
        (5 + (1 << 20), 2, None, "c", "e", usage(12)), (6 + (3 << 40), 2, 78, "c", "e", usage(1)),
    ], "exchange_id long, user_id long, session_id long, category string, entity string, "
       "usage array<struct<model string, prompt_tokens int, completion_tokens int, total_tokens int>>")
    ex = ex.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    old = {"dream_sessions": spark.createDataFrame([(77,), (78,)], "id long"),
           "dream_messages": spark.createDataFrame([(100,)], "id long"),
           "token_usage": spark.createDataFrame([], "id long")}
    out = S.log_exchanges(ex, "other", "new", old)
    ids = {t: sorted(r["id"] for r in df.collect()) for t, df in out.items()}
    assert ids["dream_sessions"] == [79, 80, 81]
    assert ids["dream_messages"] == list(range(101, 111))
    assert ids["token_usage"] == list(range(1, 44))
    assert {r["session_id"] for r in out["dream_messages"].collect()} == {77, 78, 79, 80, 81}
    ai = {r["id"] for r in out["dream_messages"].where("role = 'ai'").collect()}
    assert {r["message_id"] for r in out["token_usage"].collect()} <= ai
    alone = S.log_exchanges(ex, "other", "new")
    assert sorted(r["id"] for r in alone["dream_sessions"].collect()) == [1, 2, 3]


def test_exchange_ids_sparse_repeated_and_null(spark):
    """Any ids: every exchange gets ids of its own, in the order of a sequential log."""
    rnd = random.Random(4)
    keys = [None] * 5 + [7] * 20 + [rnd.randrange(-1 << 60, 1 << 60) for _ in range(300)]
    rows = [(k, i % 9, None if rnd.random() < 0.4 else i, "c", f"e{i}", [("m", 1, 1, 0)] * rnd.randrange(3)) for i, k in enumerate(keys)]
    rows.append(rows[7])                                   # a whole row twice
    ex = spark.createDataFrame(rows, "exchange_id long, user_id long, session_id long, category string, entity string, "
                                     "usage array<struct<model string, prompt_tokens int, completion_tokens int, total_tokens int>>")
    out = S.log_exchanges(ex.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")), "other", "new")
    asked = sorted(out["dream_messages"].where("role = 'user'").collect(), key=lambda r: r["id"])
    assert [r["id"] for r in asked] == list(range(1, 2 * len(rows), 2))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    place = {r[4]: (r[0] is not None, r[0] or 0) for r in rows}
    assert [place[r["entity"]] for r in asked] == [(r[0] is not None, r[0] or 0) for r in want]
    tokens = sorted(out["token_usage"].collect(), key=lambda r: r["id"])
    assert [r["id"] for r in tokens] == list(range(1, 1 + sum(len(r[5]) for r in rows)))
    assert [r["message_id"] for r in tokens] == sorted(r["message_id"] for r in tokens)
    assert out["dream_sessions"].count() == sum(r[2] is None for r in rows)
