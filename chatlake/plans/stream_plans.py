"""Registered streaming queries (RL3, SM1, SM2).

Each runs its stream over a file source on the table folder until all input
is processed (``availableNow``) and returns the sink as a batch DataFrame.
The oracles are the batch semantics the streams must reproduce.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.plans.limit_plans import _rl_sql
from chatlake.plans.oracle_views import with_views
from chatlake.plans.registry import register
from chatlake.sources import tables as T
from chatlake.streaming import streams as S
from chatlake.streaming.limit_stream import LimitStream


@register("RL3_rate_limit_stream", "WITH RECURSIVE " + _rl_sql("events", "user_id", "ts", "event_id", 86_400_000, 2, "rl")
          + "\nSELECT id AS event_id, limited FROM rl")
def rl3(spark, d):
    ev = T.load_stream(spark, d, "events")
    out = S.rate_limit_stream(ev, "user_id", "ts", "event_id", 86_400_000, 2)
    return S.run_to_table(out, "rl3", mode="append").select("event_id", "limited")


@register("RL3_rate_limit_stream_scanned", "WITH RECURSIVE " + _rl_sql("events", "event_type", "ts", "event_id",
                                                                        3_600_000, 3, "rl")
          + "\nSELECT id AS event_id, limited FROM rl")
def rl3_scanned(spark, d):
    """Five keys of a fifth of the events each, spread over tasks, with stored window states between batches."""
    stream = LimitStream(spark, "event_type", "ts", "event_id", 3_600_000, 3)
    stream.run(T.load_stream(spark, d, "events").select("event_id", "event_type", "ts"))
    return stream.limited().select("event_id", "limited")


@register("SM1_daily_counts_stream", with_views(["dream_messages"], """
SELECT CAST(created_at AS DATE) AS day, COUNT(*) FILTER (WHERE role = 'ai') AS ai_total,
  COUNT(*) FILTER (WHERE role = 'ai' AND feedback = 'up') AS up,
  COUNT(*) FILTER (WHERE role = 'ai' AND feedback = 'down') AS down,
  COUNT(*) FILTER (WHERE role = 'ai' AND feedback IS NULL) AS none,
  COUNT(*) FILTER (WHERE role = 'user') AS user_msgs
FROM dream_messages GROUP BY 1"""))
def sm1(spark, d):
    msgs = T.dream_messages_from(T.load_stream(spark, d, "events"))
    res = S.run_to_table(S.daily_counts_stream(msgs), "sm1", mode="update", keys=["w"])
    return res.select(F.to_date(F.col("w.start")).alias("day"), "ai_total", "up", "down", "none", "user_msgs")


@register("SM1_daily_active_users_stream", with_views(["dream_messages"], """
SELECT CAST(created_at AS DATE) AS day, COUNT(DISTINCT user_id) AS count
FROM dream_messages WHERE role = 'user' GROUP BY 1"""))
def sm1_dau(spark, d):
    msgs = T.dream_messages_from(T.load_stream(spark, d, "events"))
    res = S.run_to_table(S.active_user_days_stream(msgs), "sm1dau", mode="update", keys=["w", "user_id"])
    return res.groupBy(F.to_date(F.col("w.start")).alias("day")).agg(F.count(F.lit(1)).alias("count"))


@register("SM1_daily_signups_stream", with_views(["users"], """
SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS count FROM users WHERE created_at IS NOT NULL GROUP BY 1"""))
def sm1_signups(spark, d):
    """The fixture's signup days are not in file order, so the watermark spans them all."""
    users = T.users_from(T.load_stream(spark, d, "customer"))
    res = S.run_to_table(S.daily_signups_stream(users, "400 days"), "sm1signups", mode="update", keys=["w"])
    return res.select(F.to_date(F.col("w.start")).alias("day"), "count")


@register("SM1_daily_tokens_stream", with_views(["token_usage"], """
SELECT CAST(created_at AS DATE) AS day, CAST(COALESCE(SUM(total_tokens), 0) AS BIGINT) AS count
FROM token_usage WHERE created_at IS NOT NULL GROUP BY 1"""))
def sm1_tokens(spark, d):
    tokens = T.token_usage_from(T.load_stream(spark, d, "events"))
    res = S.run_to_table(S.daily_tokens_stream(tokens), "sm1tokens", mode="update", keys=["w"])
    return res.select(F.to_date(F.col("w.start")).alias("day"), "count")


@register("SM2_feedback_stream", with_views(["dream_messages", "feedback_events"], """
, ev AS (SELECT id, message_id, user_id, feedback, message_ts + to_minutes(seq) AS ts FROM feedback_events),
ok AS (SELECT ev.* FROM ev JOIN dream_messages m ON m.id = ev.message_id AND m.user_id = ev.user_id AND m.role = 'ai'
       WHERE ev.feedback IS NULL OR ev.feedback IN ('up', 'down'))
SELECT message_id, feedback FROM ok
QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY ts DESC, id DESC) = 1"""))
def sm2(spark, d):
    msgs_stream = T.dream_messages_from(T.load_stream(spark, d, "events"))
    ev = T.feedback_events_from(msgs_stream).withColumn(
        "ts", F.col("message_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("seq")))
    return S.feedback_stream(ev, T.dream_messages(spark, d))
