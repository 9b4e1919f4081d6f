"""Registered state-job queries (ID, ST, FB, EX, PF8, PF10, SC6) with DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chatlake.operators import state as S
from chatlake.operators import text as X
from chatlake.plans.limit_plans import _rl_sql
from chatlake.plans.oracle_views import with_views
from chatlake.plans.registry import register
from chatlake.session import checkpoint_dir
from chatlake.sources import tables as T
from chatlake.sources.lexicon import LATIN
from chatlake.sources.sinks import append_audit

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


# ---------------------------------------------------------------- ID1

_ID1 = """
, s AS (SELECT devonix_user_id, ts, NULLIF(first_name, '') AS fn, NULLIF(last_name, '') AS ln,
               last_value(NULLIF(email, '') IGNORE NULLS) OVER w AS em,
               last_value(NULLIF(phone, '') IGNORE NULLS) OVER w AS ph FROM sso_payloads
        WINDOW w AS (PARTITION BY devonix_user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
        QUALIFY row_number() OVER (PARTITION BY devonix_user_id ORDER BY ts DESC) = 1),
bi AS (SELECT s.*, u.id, u.email AS old_email, u.phone AS old_phone, u.banned
       FROM s JOIN users u ON u.devonix_user_id = s.devonix_user_id),
re AS (SELECT * FROM s WHERE devonix_user_id NOT IN (SELECT devonix_user_id FROM bi)),
be AS (SELECT re.*, u.id, u.phone AS old_phone, u.banned FROM re JOIN users u ON u.email = re.em),
ins AS (SELECT * FROM re WHERE devonix_user_id NOT IN (SELECT devonix_user_id FROM be)),
cand AS (
  SELECT devonix_user_id, id, ts, fn, ln, COALESCE(em, old_email) AS new_email, COALESCE(ph, old_phone) AS new_phone,
         CASE WHEN COALESCE(banned, false) THEN 'rejected' ELSE 'updated' END AS outcome FROM bi
  UNION ALL
  SELECT devonix_user_id, id, ts, fn, ln, em, COALESCE(ph, old_phone),
         CASE WHEN COALESCE(banned, false) THEN 'rejected' ELSE 'linked' END FROM be
  UNION ALL
  SELECT devonix_user_id, 10000000000 + devonix_user_id, ts, fn, ln, em, ph, 'inserted' FROM ins),
applied AS (SELECT * FROM cand WHERE outcome <> 'rejected'),
holders AS (SELECT new_email, count(*) AS n FROM (
              SELECT new_email FROM applied
              UNION ALL SELECT email FROM users WHERE id NOT IN (SELECT id FROM applied))
            WHERE new_email IS NOT NULL GROUP BY 1),
per_id AS (SELECT id, count(*) AS n FROM applied GROUP BY 1),
final AS (
  SELECT c.*, CASE WHEN c.outcome <> 'rejected' AND (COALESCE(h.n, 1) > 1 OR COALESCE(p.n, 1) > 1)
                   THEN 'conflict' ELSE c.outcome END AS result
  FROM cand c LEFT JOIN holders h ON h.new_email = c.new_email LEFT JOIN per_id p ON p.id = c.id)"""


@register("ID1_merge_identities", with_views(["users", "sso_payloads"], _ID1 + """
SELECT devonix_user_id, id AS user_id, result AS outcome FROM final"""))
def id1(spark, d):
    _, report = S.merge_identities(T.users(spark, d), T.sso_payloads(spark, d))
    return report


@register("ID1_users_snapshot", with_views(["users", "sso_payloads"], _ID1 + """
, ok AS (SELECT * FROM final WHERE result IN ('updated', 'linked', 'inserted'))
SELECT u.id, CASE WHEN o.id IS NULL THEN u.devonix_user_id ELSE o.devonix_user_id END AS devonix_user_id,
  CASE WHEN o.id IS NULL THEN u.first_name ELSE o.fn END AS first_name,
  CASE WHEN o.id IS NULL THEN u.last_name ELSE o.ln END AS last_name,
  CASE WHEN o.id IS NULL THEN u.email ELSE o.new_email END AS email,
  CASE WHEN o.id IS NULL THEN u.last_login_at ELSE o.ts END AS last_login_at, u.login_source
FROM users u LEFT JOIN (SELECT * FROM ok WHERE result <> 'inserted') o ON o.id = u.id
UNION ALL
SELECT id, devonix_user_id, fn, ln, new_email, ts, 'devonix' FROM ok WHERE result = 'inserted'"""))
def id1_users(spark, d):
    nxt, _ = S.merge_identities(T.users(spark, d), T.sso_payloads(spark, d))
    return nxt.select("id", "devonix_user_id", "first_name", "last_name", "email", "last_login_at", "login_source")


# ---------------------------------------------------------------- ID2

def email_logins(spark, d):
    """Verified e-mail logins from events: signups are new addresses, purchases are existing customers."""
    e = T.load(spark, d, "events").where(F.col("event_type").isin("signup", "purchase"))
    em = F.when(F.col("event_type") == "signup",
                F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com"))) \
          .otherwise(F.concat(F.lit("customer"), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit("@example.com")))
    return e.select(em.alias("email"), "ts")


@register("ID2_merge_email_logins", with_views(["users"], """
, lg AS (SELECT CASE WHEN event_type = 'signup' THEN 'u' || CAST(user_id AS VARCHAR) || '@example.com'
                     ELSE 'customer' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '@example.com' END AS email, ts
         FROM events WHERE event_type IN ('signup', 'purchase')),
l AS (SELECT email, max(ts) AS ts FROM lg GROUP BY 1)
SELECT l.email, CASE WHEN u.id IS NULL THEN 'inserted' WHEN COALESCE(u.banned, false) THEN 'rejected'
                     ELSE 'login' END AS outcome
FROM l LEFT JOIN users u ON u.email = l.email"""))
def id2(spark, d):
    _, report = S.merge_email_logins(T.users(spark, d), email_logins(spark, d))
    return report.select("email", "outcome")


# ---------------------------------------------------------------- ST1, ST2, SC6

_ACT = f"""
, v AS (SELECT *, greatest(0, months) AS mo, greatest(0, days) AS dd,
          CASE WHEN action NOT IN ('delete', 'ban', 'unban', 'suspend', 'unsuspend') THEN 'unknown_action'
               WHEN action = 'suspend' AND greatest(0, months) = 0 AND greatest(0, days) = 0 THEN 'no_duration'
          END AS reject FROM admin_actions),
ok AS (SELECT * FROM v WHERE reject IS NULL),
lb AS (SELECT target_id AS id, action = 'ban' AS b, NULLIF(reason, '') AS r FROM ok
       WHERE action IN ('ban', 'unban') QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY seq DESC) = 1),
ls AS (SELECT target_id AS id, action = 'suspend' AS s, NULLIF(reason, '') AS r,
              {AS_OF} + to_months(CAST(mo AS INTEGER)) + to_days(CAST(dd AS INTEGER)) AS su FROM ok
       WHERE action IN ('suspend', 'unsuspend') QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY seq DESC) = 1),
del AS (SELECT DISTINCT target_id AS id FROM ok WHERE action = 'delete')"""


@register("ST1_apply_actions", with_views(["users", "admin_actions"], _ACT + f"""
SELECT u.id,
  CASE WHEN lb.id IS NOT NULL THEN lb.b ELSE u.banned END AS banned,
  CASE WHEN lb.id IS NOT NULL THEN CASE WHEN lb.b THEN lb.r END ELSE u.ban_reason END AS ban_reason,
  CASE WHEN lb.id IS NOT NULL THEN CASE WHEN lb.b THEN {AS_OF} END ELSE u.banned_at END AS banned_at,
  CASE WHEN ls.id IS NOT NULL THEN CASE WHEN ls.s THEN ls.su END ELSE u.suspended_until END AS suspended_until,
  CASE WHEN ls.id IS NOT NULL THEN CASE WHEN ls.s THEN ls.r END ELSE u.suspend_reason END AS suspend_reason
FROM users u LEFT JOIN lb ON lb.id = u.id LEFT JOIN ls ON ls.id = u.id
WHERE u.id NOT IN (SELECT id FROM del)"""))
def st1(spark, d):
    nxt, _, _ = S.apply_actions(T.users(spark, d), T.admin_actions(spark, d))
    return nxt.select("id", "banned", "ban_reason", "banned_at", "suspended_until", "suspend_reason")


@register("ST2_validate_actions", with_views(["admin_actions"], _ACT + """
SELECT seq, target_id, action, reject FROM v WHERE reject IS NOT NULL"""))
def st2(spark, d):
    _, _, rejects = S.apply_actions(T.users(spark, d), T.admin_actions(spark, d))
    return rejects


@register("SC6_audit_append", with_views(["admin_actions"], _ACT + """
SELECT seq, action || '_user' AS action, target_id AS target_user_id FROM ok"""))
def sc6(spark, d):
    """Audit rows appended with the actions' batch (run twice), read back."""
    _, audit, _ = S.apply_actions(T.users(spark, d), T.admin_actions(spark, d))
    path = f"{checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    for _ in range(2):
        append_audit(audit, path, "actions")
    return spark.read.parquet(path).select(*audit.columns)


# ---------------------------------------------------------------- ST3

def setting_changes(spark, d):
    e = T.load(spark, d, "events")
    normal = e.select(F.col("event_type").alias("key"), F.floor("value").cast("bigint").cast("string").alias("value"),
                      F.col("event_id").alias("seq"))
    maint = e.where(F.col("event_type") == "error").select(
        F.lit("maintenance_mode").alias("key"), F.when(F.col("value") > 50, "true").otherwise("false").alias("value"),
        F.col("event_id").alias("seq"))
    return normal.unionByName(maint)


@register("ST3_upsert_setting", with_views([], """
, ch AS (SELECT event_type AS key, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value, event_id AS seq FROM events
         UNION ALL
         SELECT 'maintenance_mode', CASE WHEN value > 50 THEN 'true' ELSE 'false' END, event_id FROM events
         WHERE event_type = 'error'),
l AS (SELECT key, value FROM ch QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
SELECT key, value FROM l
UNION ALL SELECT 'maintenance_mode', 'false' WHERE NOT EXISTS (SELECT 1 FROM l WHERE key = 'maintenance_mode')"""))
def st3(spark, d):
    return S.upsert_settings(T.app_settings(spark), setting_changes(spark, d))


# ---------------------------------------------------------------- ST4

_ST4 = """
, gone AS (SELECT id FROM users WHERE banned = true),
u2 AS (SELECT * FROM users WHERE id NOT IN (SELECT id FROM gone)),
s2 AS (SELECT * FROM dream_sessions WHERE user_id NOT IN (SELECT id FROM gone)),
m2 AS (SELECT * FROM dream_messages WHERE user_id NOT IN (SELECT id FROM gone)
       AND session_id IN (SELECT id FROM s2)),
t2 AS (SELECT t.id, t.user_id, CASE WHEN t.message_id IN (SELECT id FROM m2) THEN t.message_id END AS message_id
       FROM token_usage t WHERE t.user_id NOT IN (SELECT id FROM gone))"""


@register("ST4_cascade_delete", with_views(["users", "dream_sessions", "dream_messages", "token_usage"], _ST4 + """
SELECT 'users' AS tbl, COUNT(*) AS n FROM u2 UNION ALL SELECT 'dream_sessions', COUNT(*) FROM s2
UNION ALL SELECT 'dream_messages', COUNT(*) FROM m2 UNION ALL SELECT 'token_usage', COUNT(*) FROM t2
UNION ALL SELECT 'token_usage_nulled', COUNT(*) FROM t2 WHERE message_id IS NULL"""))
def st4(spark, d):
    users = T.users(spark, d)
    out = S.cascade_delete(users, T.dream_sessions(spark, d), T.dream_messages(spark, d), T.token_usage(spark, d),
                           users.where(F.col("banned") == F.lit(True)).select("id"))
    parts = [out[k].select(F.lit(k).alias("tbl"), F.lit(1).alias("x")) for k in
             ["users", "dream_sessions", "dream_messages", "token_usage"]]
    parts.append(out["token_usage"].where(F.col("message_id").isNull()).select(
        F.lit("token_usage_nulled").alias("tbl"), F.lit(1).alias("x")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    counts = u.groupBy("tbl").agg(F.count(F.lit(1)).alias("n"))
    zero = spark.createDataFrame([(t,) for t in ["users", "dream_sessions", "dream_messages", "token_usage",
                                                 "token_usage_nulled"]], "tbl string")
    return zero.join(counts, "tbl", "left").select("tbl", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@register("ST4_tokens_after_delete", with_views(["users", "dream_sessions", "dream_messages", "token_usage"], _ST4 + """
SELECT id, user_id, message_id FROM t2"""))
def st4_tokens(spark, d):
    users = T.users(spark, d)
    out = S.cascade_delete(users, T.dream_sessions(spark, d), T.dream_messages(spark, d), T.token_usage(spark, d),
                           users.where(F.col("banned") == F.lit(True)).select("id"))
    return out["token_usage"].select("id", "user_id", "message_id")


# ---------------------------------------------------------------- FB1, FB2

def feedback_event_rows(spark, d):
    fe = T.feedback_events(spark, d)
    return fe.withColumn("ts", F.col("message_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("seq")))


@register("FB1_latest_feedback", with_views(["dream_messages", "feedback_events"], """
, ev AS (SELECT id, message_id, user_id, feedback, message_ts + to_minutes(seq) AS ts FROM feedback_events),
ok AS (SELECT ev.* FROM ev JOIN dream_messages m ON m.id = ev.message_id AND m.user_id = ev.user_id AND m.role = 'ai'
       WHERE ev.feedback IS NULL OR ev.feedback IN ('up', 'down')),
last AS (SELECT message_id, feedback FROM ok
         QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY ts DESC, id DESC) = 1)
SELECT m.id, CASE WHEN l.message_id IS NOT NULL THEN l.feedback ELSE m.feedback END AS feedback
FROM dream_messages m LEFT JOIN last l ON l.message_id = m.id WHERE m.role = 'ai'"""))
def fb1(spark, d):
    msgs = T.dream_messages(spark, d)
    out = S.latest_feedback(msgs, feedback_event_rows(spark, d))
    return out.where(F.col("role") == "ai").select("id", "feedback")


@register("FB2_toggle_feedback", with_views(["dream_messages", "feedback_events"], """
, c AS (SELECT message_id, id, message_ts + to_minutes(seq) AS ts, feedback AS click FROM feedback_events
        WHERE feedback IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ts, id)
              - row_number() OVER (PARTITION BY message_id, click ORDER BY ts, id) AS grp FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY message_id, click, grp ORDER BY ts, id) AS pos,
                row_number() OVER (PARTITION BY message_id ORDER BY ts DESC, id DESC) AS lastrn FROM r)
SELECT message_id, CASE WHEN pos % 2 = 1 THEN click END AS feedback FROM p WHERE lastrn = 1"""))
def fb2(spark, d):
    clicks = feedback_event_rows(spark, d).where(F.col("feedback").isNotNull()).select(
        "message_id", "id", "ts", F.col("feedback").alias("click"))
    return S.toggle_feedback(clicks)


# ---------------------------------------------------------------- EX1

def exchanges(spark, d):
    """One exchange per user turn: labels from TX1, token usage derived from the turn."""
    t = X.classify(T.chat_turns(spark, d).where(F.col("role") == "user"), "text", LATIN)
    ln = F.length("text")
    usage = F.array(
        F.struct(F.lit("m-groq").alias("model"), (ln % 100).alias("prompt_tokens"),
                 (F.col("turn") * 10).cast("int").alias("completion_tokens"), F.lit(0).alias("total_tokens")),
        F.struct(F.lit("openrouter:m-or").alias("model"), F.lit(0).alias("prompt_tokens"),
                 (ln % 7).alias("completion_tokens"),
                 F.when(F.col("turn") % 4 == 0, F.lit(5)).otherwise(F.lit(0)).alias("total_tokens")))
    return t.select((F.col("conv_id") * 10000 + F.col("turn")).alias("exchange_id"), F.col("conv_id").alias("user_id"),
                    F.when(F.col("turn") == 0, F.lit(None).cast("bigint")).otherwise(F.col("conv_id") * 100).alias("session_id"),
                    "category", "entity",
                    (T.ts_lit("2024-01-01 00:00:00") + F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"),
                                                                         F.col("turn").cast("int"))).alias("ts"),
                    usage.alias("usage"))


def _ex_sql() -> str:
    from chatlake.plans.text_plans import _classify_sql, _q
    return _classify_sql("chat_turns", "conv_id * 10000 + turn", "text") + f"""
, ex AS (SELECT c.conv_id * 10000 + c.turn AS exchange_id, c.conv_id AS user_id,
           CASE WHEN c.turn = 0 THEN NULL ELSE c.conv_id * 100 END AS session_id,
           COALESCE(h.category, {_q(LATIN.default_category)}) AS category, trim(h.keyword) AS entity,
           TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(c.conv_id AS INTEGER)) + to_minutes(CAST(c.turn AS INTEGER)) AS ts,
           length(c.text) AS ln, c.turn
         FROM chat_turns c LEFT JOIN hits h ON h.k = c.conv_id * 10000 + c.turn WHERE c.role = 'user'),
numbered AS (SELECT *, (SELECT max(conv_id) * 100 FROM chat_turns)
           + count(*) FILTER (WHERE session_id IS NULL) OVER (ORDER BY exchange_id) AS sid,
         row_number() OVER (ORDER BY exchange_id) AS n FROM ex)"""


def _logged(spark, d):
    sessions = T.chat_turns(spark, d).select((F.col("conv_id") * 100).alias("id"))
    return S.log_exchanges(exchanges(spark, d), LATIN.default_category, LATIN.no_category_title,
                           {"dream_sessions": sessions})


@register("EX1_sessions", with_views(["chat_turns"], _ex_sql() + f"""
SELECT sid AS id, user_id,
  CASE WHEN category IS NULL OR category = 'other' THEN {'%s' % "'new chat'"} ELSE category END AS title,
  ts AS created_at FROM numbered WHERE session_id IS NULL"""))
def ex1_sessions(spark, d):
    return _logged(spark, d)["dream_sessions"]


@register("EX1_messages", with_views(["chat_turns"], _ex_sql() + """
SELECT n * 2 - 1 AS id, COALESCE(session_id, sid) AS session_id, user_id, 'user' AS role, '' AS content,
  category, entity, CAST(NULL AS VARCHAR) AS feedback, ts AS created_at FROM numbered
UNION ALL
SELECT n * 2, COALESCE(session_id, sid), user_id, 'ai', '', NULL, NULL, NULL, ts FROM numbered"""))
def ex1_messages(spark, d):
    return _logged(spark, d)["dream_messages"]


@register("EX1_tokens", with_views(["chat_turns"], _ex_sql() + """
SELECT n * 2 - 1 AS id, user_id, n * 2 AS message_id, 'm-groq' AS model,
  CAST(ln % 100 AS BIGINT) AS prompt_tokens, CAST(turn * 10 AS BIGINT) AS completion_tokens,
  CAST(ln % 100 + turn * 10 AS BIGINT) AS total_tokens, ts AS created_at FROM numbered
UNION ALL
SELECT n * 2, user_id, n * 2, 'openrouter:m-or', 0, CAST(ln % 7 AS BIGINT),
  CAST(CASE WHEN turn % 4 = 0 THEN 5 ELSE ln % 7 END AS BIGINT), ts FROM numbered"""))
def ex1_tokens(spark, d):
    return _logged(spark, d)["token_usage"]


# ---------------------------------------------------------------- PF8, PF10

@register("PF8_otp_format", """
SELECT event_id, CAST(CAST(floor(value * 10000) AS BIGINT) AS VARCHAR) AS code,
  regexp_full_match(CAST(CAST(floor(value * 10000) AS BIGINT) AS VARCHAR), '[0-9]{6}') AS valid FROM events""")
def pf8(spark, d):
    e = T.load(spark, d, "events")
    code = F.floor(F.col("value") * 10000).cast("bigint").cast("string")
    return e.select("event_id", code.alias("code"), code.rlike(r"^[0-9]{6}\z").alias("valid"))


def requests(spark, d):
    """Chat requests from user turns: user = conversation * 15 (none every 13th conversation)."""
    t = T.chat_turns(spark, d).where(F.col("role") == "user")
    return t.select((F.col("conv_id") * 100 + F.col("turn")).alias("request_id"),
                    F.when(F.col("conv_id") % 13 == 0, F.lit(None).cast("bigint"))
                     .otherwise(F.col("conv_id") * 15).alias("user_id"),
                    F.concat(F.lit("10.0."), (F.col("conv_id") % 4).cast("string"), F.lit(".1")).alias("ip"),
                    (T.ts_lit("2024-01-30 00:00:00") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                                         F.col("turn").cast("int"))).alias("ts"),
                    "text")


@register("PF10_account_gate", with_views(["users", "chat_turns"], """
, r AS (SELECT conv_id * 100 + turn AS request_id, CASE WHEN conv_id % 13 = 0 THEN NULL ELSE conv_id * 15 END AS user_id,
               TIMESTAMP '2024-01-30 00:00:00' + to_seconds(CAST(turn AS INTEGER)) AS ts, text
        FROM chat_turns WHERE role = 'user')
SELECT r.request_id, CASE WHEN r.user_id IS NULL OR u.id IS NULL THEN 'no_account'
  WHEN COALESCE(u.banned, false) THEN 'banned'
  WHEN COALESCE(u.suspended_until > r.ts, false) THEN 'suspended'
  WHEN r.text IS NULL THEN 'missing'
  WHEN length(regexp_replace(r.text, '^\\s+|\\s+$', '', 'g')) < 2 THEN 'too_short'
  WHEN length(r.text) > 6000 THEN 'too_long' ELSE 'ok' END AS gate
FROM r LEFT JOIN users u ON u.id = r.user_id"""))
def pf10(spark, d):
    g = S.account_gate(requests(spark, d), T.users(spark, d), T.app_settings(spark))
    return g.select("request_id", "gate")


def _gate_sql_base() -> str:
    return """
r AS (SELECT conv_id * 100 + turn AS request_id, CASE WHEN conv_id % 13 = 0 THEN NULL ELSE conv_id * 15 END AS user_id,
             '10.0.' || CAST(conv_id % 4 AS VARCHAR) || '.1' AS ip,
             TIMESTAMP '2024-01-30 00:00:00' + to_seconds(CAST(turn AS INTEGER)) AS ts, text
      FROM chat_turns WHERE role = 'user'),
g0 AS (SELECT r.*, CASE WHEN r.user_id IS NULL OR u.id IS NULL THEN 'no_account'
                        WHEN COALESCE(u.banned, false) THEN 'banned'
                        WHEN COALESCE(u.suspended_until > r.ts, false) THEN 'suspended' END AS early
       FROM r LEFT JOIN users u ON u.id = r.user_id),
surv AS (SELECT * FROM g0 WHERE early IS NULL),"""


@register("PF10_gate_with_limits", "WITH RECURSIVE " + with_views(["users", "chat_turns"], "").replace("WITH ", "", 1)
          + ",\n" + _gate_sql_base()
          + _rl_sql(
              "surv", "ip", "ts", "request_id", 60_000, 15, "a") + ",\n"
          + "pass AS (SELECT s.* FROM surv s JOIN a ON a.id = s.request_id WHERE NOT a.limited),"
          + _rl_sql(
              "pass", "user_id", "ts", "request_id", 60_000, 20, "b") + """
SELECT g0.request_id, CASE WHEN g0.early IS NOT NULL THEN g0.early
  WHEN COALESCE(a.limited, false) OR COALESCE(b.limited, false) THEN 'rate_limited'
  WHEN g0.text IS NULL THEN 'missing'
  WHEN length(trim(g0.text)) < 2 THEN 'too_short'
  WHEN length(g0.text) > 6000 THEN 'too_long' ELSE 'ok' END AS gate
FROM g0 LEFT JOIN a ON a.id = g0.request_id LEFT JOIN b ON b.id = g0.request_id""")
def pf10_limits(spark, d):
    """PF10 with RL2: only requests that pass the account gates count against the limits."""
    from chatlake.operators import limits as L
    req = requests(spark, d)
    users = T.users(spark, d)
    settings = T.app_settings(spark)
    first = S.account_gate(req, users, settings)
    survivors = first.where(~F.col("gate").isin("no_account", "banned", "suspended", "maintenance"))
    lim = L.rate_limit_chain(survivors.select("request_id", "user_id", "ip", "ts"))
    return S.account_gate(req, users, settings, rate_limited=lim.select("request_id", "limited")) \
        .select("request_id", "gate")
