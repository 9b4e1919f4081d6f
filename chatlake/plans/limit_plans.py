"""Registered abuse-control queries (RL1, RL2, OT1, OT2) with DuckDB oracles.

The oracles are recursive CTEs (window-start chains, OTP state walk) and
correlated counts, independent of the Spark folds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.operators import limits as L
from chatlake.plans.oracle_views import with_views
from chatlake.plans.registry import register
from chatlake.sources import tables as T


def _rl_sql(src: str, key: str, ts: str, tie: str, window_ms: int, max_count: int, name: str) -> str:
    """CTE ``name``: (tie, limited) for every row of ``src`` (anchored windows per key)."""
    return f"""
{name}_ev AS MATERIALIZED (SELECT {key} AS k, {ts} AS ts, {tie} AS id FROM {src}),
{name}_nx AS MATERIALIZED (SELECT a.k, a.ts, min(b.ts) AS nts FROM (SELECT DISTINCT k, ts FROM {name}_ev) a
              LEFT JOIN {name}_ev b ON b.k = a.k AND b.ts > a.ts + INTERVAL ({window_ms}) MILLISECOND
              GROUP BY a.k, a.ts),
{name}_st(k, s) AS (SELECT k, min(ts) FROM {name}_ev GROUP BY k
                    UNION ALL
                    SELECT st.k, nx.nts FROM {name}_st st JOIN {name}_nx nx ON nx.k = st.k AND nx.ts = st.s
                    WHERE nx.nts IS NOT NULL),
{name}_win AS MATERIALIZED (SELECT e.k, e.ts, e.id, max(st.s) AS ws FROM {name}_ev e
               JOIN {name}_st st ON st.k = e.k AND st.s <= e.ts GROUP BY e.k, e.ts, e.id),
{name} AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY k, ws ORDER BY ts, id) > {max_count} AS limited
           FROM {name}_win)"""


@register("RL1_rate_limit", "WITH RECURSIVE " + _rl_sql("events", "user_id", "ts", "event_id", 86_400_000, 2, "rl")
          + "\nSELECT id AS event_id, limited FROM rl")
def rl1(spark, d):
    e = T.load(spark, d, "events").select("event_id", "user_id", "ts")
    return L.rate_limit(e, "user_id", "ts", 86_400_000, 2, tie="event_id").select("event_id", "limited")


def chat_requests(spark, d):
    """Requests from events: the event's user, an IP shared by 16 user groups."""
    e = T.load(spark, d, "events")
    return e.select(F.col("event_id").alias("request_id"), "user_id",
                    F.concat(F.lit("10.0.0."), (F.col("user_id") % 16).cast("string")).alias("ip"), "ts")


@register("RL2_rate_limit_chain", "WITH RECURSIVE req AS MATERIALIZED (SELECT event_id AS request_id, user_id, "
          "'10.0.0.' || CAST(user_id % 16 AS VARCHAR) AS ip, ts FROM events),"
          + _rl_sql("req", "ip", "ts", "request_id", 60_000, 15, "a") + ",\n"
          + "pass AS MATERIALIZED (SELECT r.* FROM req r JOIN a ON a.id = r.request_id WHERE NOT a.limited),"
          + _rl_sql("pass", "user_id", "ts", "request_id", 60_000, 20, "b") + """
SELECT id AS request_id, true AS limited, 'ip' AS by FROM a WHERE limited
UNION ALL SELECT id, limited, CASE WHEN limited THEN 'user' END FROM b""")
def rl2(spark, d):
    return L.rate_limit_chain(chat_requests(spark, d)).select("request_id", "limited", "by")


@register("RL1_rate_limit_hourly", "WITH RECURSIVE " + _rl_sql("events", "event_type", "ts", "event_id",
                                                                3_600_000, 3, "rl")
          + "\nSELECT id AS event_id, limited FROM rl")
def rl1_hourly(spark, d):
    """Same operator keyed by event type: 5 keys of ~20% of rows each, which span partitions."""
    e = T.load(spark, d, "events").select("event_id", "event_type", "ts")
    return L.rate_limit(e, "event_type", "ts", 3_600_000, 3, tie="event_id").select("event_id", "limited")


@register("OT1_rolling_sends", with_views(["send_log"], """
, c AS (
  SELECT s.id, s.email, s.ip, s.created_at,
    (SELECT count(*) FROM send_log p WHERE p.email = s.email AND (p.created_at, p.id) < (s.created_at, s.id)
       AND p.created_at > s.created_at - INTERVAL 15 MINUTE) AS prior_email,
    (SELECT count(*) FROM send_log p WHERE p.ip = s.ip AND (p.created_at, p.id) < (s.created_at, s.id)
       AND p.created_at > s.created_at - INTERVAL 1 HOUR) AS prior_ip
  FROM send_log s)
SELECT *, prior_email >= 3 AS email_limited, prior_ip >= 10 AS ip_limited FROM c"""))
def ot1(spark, d):
    return L.rolling_sends(T.send_log(spark, d)).select("id", "email", "ip", "created_at", "prior_email", "prior_ip",
                                                       "email_limited", "ip_limited")


def otp_events(spark, d):
    """Sends (signups) and verify attempts (clicks) per e-mail, codes derived from the user id."""
    e = T.load(spark, d, "events").where(F.col("event_type").isin("signup", "click"))
    good = F.lpad(((F.col("user_id") * 7919) % 1000000).cast("string"), 6, "0")
    bad = F.lpad(((F.col("user_id") * 7919 + 1) % 1000000).cast("string"), 6, "0")
    code = (F.when(F.col("event_type") == "signup", good).when(F.col("value") < 50, good)
             .when(F.col("value") < 95, bad).otherwise(F.concat(F.lit("x"), bad)))
    return e.select(F.col("event_id").alias("id"),
                    F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
                    "ts", F.when(F.col("event_type") == "signup", "send").otherwise("attempt").alias("kind"),
                    code.alias("code"))


@register("OT2_otp_outcomes", """WITH RECURSIVE ev AS (
  SELECT event_id AS id, 'u' || CAST(user_id AS VARCHAR) || '@example.com' AS email, ts,
    CASE WHEN event_type = 'signup' THEN 'send' ELSE 'attempt' END AS kind,
    CASE WHEN event_type = 'signup' OR value < 50 THEN lpad(CAST((user_id * 7919) % 1000000 AS VARCHAR), 6, '0')
         WHEN value < 95 THEN lpad(CAST((user_id * 7919 + 1) % 1000000 AS VARCHAR), 6, '0')
         ELSE 'x' || lpad(CAST((user_id * 7919 + 1) % 1000000 AS VARCHAR), 6, '0') END AS code
  FROM events WHERE event_type IN ('signup', 'click')),
seq AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY ts, id) AS rn FROM ev),
walk(email, rn, id, h, exp, att, outcome) AS (
  SELECT DISTINCT email, 0, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), 0,
         CAST(NULL AS VARCHAR) FROM seq
  UNION ALL
  SELECT e.email, e.rn, e.id,
    CASE WHEN e.kind = 'send' THEN sha256(e.code)
         WHEN e.code IS NULL OR e.code = '' OR NOT regexp_full_match(e.code, '[0-9]{6}') OR w.h IS NULL THEN w.h
         WHEN w.exp < e.ts OR w.att >= 5 THEN NULL
         WHEN sha256(e.code) <> w.h THEN w.h ELSE NULL END,
    CASE WHEN e.kind = 'send' THEN e.ts + INTERVAL 10 MINUTE ELSE w.exp END,
    CASE WHEN e.kind = 'send' THEN 0
         WHEN e.code IS NULL OR e.code = '' OR NOT regexp_full_match(e.code, '[0-9]{6}') OR w.h IS NULL THEN w.att
         WHEN w.exp < e.ts OR w.att >= 5 THEN w.att
         WHEN sha256(e.code) <> w.h THEN w.att + 1 ELSE w.att END,
    CASE WHEN e.kind = 'send' THEN 'sent'
         WHEN e.code IS NULL OR e.code = '' THEN 'missing'
         WHEN NOT regexp_full_match(e.code, '[0-9]{6}') THEN 'bad_format'
         WHEN w.h IS NULL THEN 'no_code'
         WHEN w.exp < e.ts THEN 'expired'
         WHEN w.att >= 5 THEN 'too_many'
         WHEN sha256(e.code) <> w.h THEN 'incorrect' ELSE 'ok' END
  FROM walk w JOIN seq e ON e.email = w.email AND e.rn = w.rn + 1)
SELECT id, outcome FROM walk WHERE rn > 0""")
def ot2(spark, d):
    return L.otp_outcomes(otp_events(spark, d))
