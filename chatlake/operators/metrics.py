"""Usage analytics: totals, daily/monthly series, top-k, per-user summaries.

Every relative window is ``created_at > as_of - interval`` with no upper
bound (future rows count), evaluated against an explicit ``as_of`` so results
never depend on the wall clock.  Aggregates are plain ``groupBy().agg()`` with
``count_if``/``sum(when)`` so Spark does one partial (map-side) aggregation
per scan; the daily/monthly series push the time predicate into the parquet
scan so only recent row groups are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.scalars import display_name  # noqa: F401  (SF2, re-exported)
from chatlake.functions.semantics import js_trim_py, pg_desc
from chatlake.sources.tables import DEFAULT_AS_OF, ts_lit


def since(as_of: str, interval: str) -> Column:
    """``now() - interval '<interval>'`` as an NTZ timestamp column."""
    return ts_lit(as_of) - F.expr(f"INTERVAL {interval}")


def after(col: str, as_of: str, interval: str) -> Column:
    return F.col(col) > since(as_of, interval)


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


# ------------------------------------------------------------------ PF5

def model_group(model: Column | str = "model") -> Column:
    """PF5: provider group of a model name (case-sensitive LIKE; NULL → Groq)."""
    m = F.col(model) if isinstance(model, str) else model
    return (F.when(m.like("openrouter:%"), "OpenRouter")
             .when(m.like("synthesis:%"), "Synthesis")
             .otherwise("Groq"))


# ------------------------------------------------------------------ AG1-AG3

def user_totals(users: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """AG1: one row of user counts."""
    return users.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count_if(F.col("login_source") == "devonix").alias("users_via_devonix"),
        F.count_if(F.col("login_source") == "email").alias("users_via_email"),
        F.count_if(F.col("banned") == F.lit(True)).alias("banned_users"),
        F.count_if(after("created_at", as_of, "1 DAY")).alias("new_today"),
        F.count_if(after("created_at", as_of, "7 DAYS")).alias("new_last_7_days"),
        F.count_if(after("created_at", as_of, "30 DAYS")).alias("new_last_30_days"),
    )


def token_totals(tokens: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """AG2: token sums (0 when empty) and request count."""
    t = F.col("total_tokens")
    return tokens.agg(
        zero_if_null(F.sum(t)).alias("total_tokens"),
        zero_if_null(F.sum(F.when(after("created_at", as_of, "1 DAY"), t))).alias("tokens_today"),
        zero_if_null(F.sum(F.when(after("created_at", as_of, "30 DAYS"), t))).alias("tokens_last_30_days"),
        F.count(F.lit(1)).alias("total_requests"),
    )


def feedback_totals(msgs: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """AG3: up/down counts on AI messages, all time / 1 day / 30 days."""
    fb = F.col("feedback")
    d1 = after("created_at", as_of, "1 DAY")
    d30 = after("created_at", as_of, "30 DAYS")
    return msgs.where(F.col("role") == "ai").agg(
        F.count_if(fb == "up").alias("total_up"),
        F.count_if(fb == "down").alias("total_down"),
        F.count_if((fb == "up") & d1).alias("up_today"),
        F.count_if((fb == "down") & d1).alias("down_today"),
        F.count_if((fb == "up") & d30).alias("up_last_30_days"),
        F.count_if((fb == "down") & d30).alias("down_last_30_days"),
    )


# ------------------------------------------------------------------ AG4-AG10

def _daily(df: DataFrame, as_of: str, value: Column) -> DataFrame:
    return (df.where(after("created_at", as_of, "30 DAYS"))
              .groupBy(F.to_date("created_at").alias("day"))
              .agg(value.alias("count")))


def _monthly(df: DataFrame, as_of: str, value: Column) -> DataFrame:
    return (df.where(after("created_at", as_of, "12 MONTHS"))
              .groupBy(F.date_format("created_at", "yyyy-MM").alias("month"))
              .agg(value.alias("count")))


def daily_users(users: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """AG4: signups per UTC day over the last 30 days."""
    return _daily(users, as_of, F.count(F.lit(1))).orderBy("day")


def daily_active_users(msgs: DataFrame, as_of: str = DEFAULT_AS_OF, approx: bool = False) -> DataFrame:
    """AG5: distinct users with a user message per day (30 days)."""
    u = F.approx_count_distinct("user_id") if approx else F.count_distinct("user_id")
    return _daily(msgs.where(F.col("role") == "user"), as_of, u).orderBy("day")


def daily_tokens(tokens: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """AG6: token sum per day (30 days)."""
    return _daily(tokens, as_of, zero_if_null(F.sum("total_tokens"))).orderBy("day")


def daily_feedback(msgs: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """AG7: AI messages per day with up/down/none counts (30 days)."""
    fb = F.col("feedback")
    return (msgs.where((F.col("role") == "ai") & after("created_at", as_of, "30 DAYS"))
                .groupBy(F.to_date("created_at").alias("day"))
                .agg(F.count(F.lit(1)).alias("total"),
                     F.count_if(fb == "up").alias("up"),
                     F.count_if(fb == "down").alias("down"),
                     F.count_if(fb.isNull()).alias("none"))
                .orderBy("day"))


def monthly_users(users: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """AG8: signups per 'yyyy-MM' over the last 12 months."""
    return _monthly(users, as_of, F.count(F.lit(1))).orderBy("month")


def monthly_active_users(msgs: DataFrame, as_of: str = DEFAULT_AS_OF, approx: bool = False) -> DataFrame:
    """AG9: distinct users with a user message per month (12 months)."""
    u = F.approx_count_distinct("user_id") if approx else F.count_distinct("user_id")
    return _monthly(msgs.where(F.col("role") == "user"), as_of, u).orderBy("month")


def monthly_tokens(tokens: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """AG10: token sum per month (12 months)."""
    return _monthly(tokens, as_of, zero_if_null(F.sum("total_tokens"))).orderBy("month")


# ------------------------------------------------------------------ AG11-AG14

def top_categories(msgs: DataFrame, k: int = 20, as_of: str = DEFAULT_AS_OF,
                   days: int | None = None) -> DataFrame:
    """AG11/AG12: most frequent categories of user messages (ties by name).

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each partition keeps
    its own top-k, so only k rows per partition reach the final merge.
    """
    f = (F.col("role") == "user") & F.col("category").isNotNull()
    if days is not None:
        f = f & after("created_at", as_of, f"{days} DAYS")
    return (msgs.where(f).groupBy("category").agg(F.count(F.lit(1)).alias("count"))
                .orderBy(F.col("count").desc(), F.col("category").asc()).limit(k))


def entity_breakdown(msgs: DataFrame, category: str | None = None, k: int = 20) -> DataFrame:
    """AG13: top-k entities per category plus the category total (NULL entities included).

    With ``category=None`` every category is broken down at once; the
    per-category top-k is a ``row_number() <= k`` filter, which Spark plans as
    a WindowGroupLimit before the window shuffle; the totals are a grouping of
    their own, joined to the few ranked rows.
    """
    m = msgs.where((F.col("role") == "user") & F.col("category").isNotNull())
    if category is not None:
        m = m.where(F.col("category") == category)
    base = (m.groupBy("category", "entity")
             .agg(F.count(F.lit(1)).alias("count")))
    total = (base.groupBy(F.col("category").alias("c")).agg(F.sum("count").alias("total")))
    w_rank = Window.partitionBy("category").orderBy(F.col("count").desc(), F.col("entity").asc())
    top = (base.where(F.col("entity").isNotNull())
               .withColumn("rank", F.row_number().over(w_rank)).where(F.col("rank") <= k))
    return top.join(total, F.col("category") == F.col("c")).select("category", "entity", "count", "total", "rank")


def model_breakdown(tokens: DataFrame) -> DataFrame:
    """AG14: requests and tokens per provider group, tokens descending."""
    return (tokens.groupBy(model_group("model").alias("model_group"))
                  .agg(F.count(F.lit(1)).alias("requests"),
                       zero_if_null(F.sum("total_tokens")).alias("tokens"))
                  .orderBy(F.col("tokens").desc(), "model_group"))


# ------------------------------------------------------------------ AG15-AG18

def user_token_summary(tokens: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """AG15: per user token totals, last-30-day tokens and requests."""
    t = F.col("total_tokens")
    return tokens.groupBy("user_id").agg(
        zero_if_null(F.sum(t)).alias("total_tokens"),
        zero_if_null(F.sum(F.when(after("created_at", as_of, "30 DAYS"), t))).alias("tokens_last_30_days"),
        F.count(F.lit(1)).alias("total_requests"))


def user_feedback_summary(msgs: DataFrame) -> DataFrame:
    """AG16: per user up/down counts on AI messages."""
    fb = F.col("feedback")
    return (msgs.where(F.col("role") == "ai").groupBy("user_id")
                .agg(F.count_if(fb == "up").alias("up_count"),
                     F.count_if(fb == "down").alias("down_count")))


def user_top_categories(msgs: DataFrame, k: int = 10) -> DataFrame:
    """AG17: per user top-k categories (ties by name) with rank."""
    base = (msgs.where((F.col("role") == "user") & F.col("category").isNotNull())
                .groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("count")))
    w = Window.partitionBy("user_id").orderBy(F.col("count").desc(), F.col("category").asc())
    return base.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


USER_DETAIL_COLUMNS = ["id", "login_source", "first_name", "last_name", "email", "phone",
                       "profile_picture", "plan", "banned", "ban_reason", "banned_at",
                       "suspended_until", "suspend_reason", "created_at", "last_login_at"]


def user_detail(users: DataFrame, tokens: DataFrame, msgs: DataFrame,
                ids: DataFrame | None = None, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """AG18: user columns + token summary + feedback summary + top-10 categories.

    ``ids`` (a one-column ``id`` DataFrame) restricts to some users; missing
    ids give no row.  All three summaries are pre-aggregated by user_id and
    left-joined, so each fact table is scanned once whatever the user count.
    """
    u = users.select(*USER_DETAIL_COLUMNS)
    if ids is not None:
        u = u.join(ids.select("id").distinct(), "id", "left_semi")
    ts = user_token_summary(tokens, as_of).withColumnRenamed("user_id", "id")
    fs = user_feedback_summary(msgs).withColumnRenamed("user_id", "id")
    tc = (user_top_categories(msgs)
          .groupBy(F.col("user_id").alias("id"))
          .agg(F.array_sort(F.collect_list(F.struct("rank", "category", "count"))).alias("tc")))
    out = (u.join(ts, "id", "left").join(fs, "id", "left").join(tc, "id", "left"))
    return out.select(
        *USER_DETAIL_COLUMNS,
        zero_if_null(F.col("total_tokens")).alias("total_tokens"),
        zero_if_null(F.col("tokens_last_30_days")).alias("tokens_last_30_days"),
        zero_if_null(F.col("total_requests")).alias("total_requests"),
        zero_if_null(F.col("up_count")).alias("up_count"),
        zero_if_null(F.col("down_count")).alias("down_count"),
        F.coalesce(F.transform("tc", lambda x: F.struct(x["category"].alias("category"),
                                                          x["count"].alias("count"))),
                   F.array().cast("array<struct<category:string,count:bigint>>")).alias("top_categories"),
    )


# ------------------------------------------------------------------ AG19-AG21

def knowledge_summary(chunks: DataFrame) -> DataFrame:
    """AG19: per tradition chunk count and last insert time, plus the grand total.

    The total is a window sum over the per-tradition aggregate, which has one
    row per tradition (tiny), so the unpartitioned window is cheap.
    """
    per = chunks.groupBy("tradition").agg(F.count(F.lit(1)).alias("chunk_count"),
                                          F.max("created_at").alias("last_added"))
    return per.withColumn("total", F.sum("chunk_count").over(Window.partitionBy())).orderBy("tradition")


def _long(df: DataFrame, section: str, bucket: Column | None, metrics: list[str]) -> DataFrame:
    b = bucket.cast("string") if bucket is not None else F.lit("")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("bigint").alias("value"))
                      for m in metrics])
    return (df.select(F.lit(section).alias("section"), b.alias("bucket"), F.explode(pairs).alias("p"))
              .select("section", "bucket", "p.metric", "p.value"))


def _flags(as_of: str) -> list[Column]:
    return [F.to_date("created_at").alias("day"),
            F.date_format("created_at", "yyyy-MM").alias("month"),
            F.coalesce(after("created_at", as_of, "1 DAY"), F.lit(False)).alias("f1"),
            F.coalesce(after("created_at", as_of, "7 DAYS"), F.lit(False)).alias("f7"),
            F.coalesce(after("created_at", as_of, "30 DAYS"), F.lit(False)).alias("f30"),
            F.coalesce(after("created_at", as_of, "12 MONTHS"), F.lit(False)).alias("f12")]


def _materialise(*dfs: DataFrame) -> list[DataFrame]:
    """Write small intermediates once (reliable checkpoints in the shared folder) and read them back.

    Used for the dashboard pre-aggregates, whose size is bounded by days x
    dimension values, never by fact rows.  Unlike ``cache()`` this cuts the
    lineage, survives executor loss, and is never matched by a later query.
    The independent checkpoint jobs are submitted concurrently from driver
    threads, so the scheduler runs them side by side.
    """
    from concurrent.futures import ThreadPoolExecutor

    from chatlake.session import checkpoint_dir
    checkpoint_dir(dfs[0].sparkSession)
    with ThreadPoolExecutor(max_workers=len(dfs)) as pool:
        return list(pool.map(lambda d: d.checkpoint(eager=True), dfs))


def dashboard(users: DataFrame, msgs: DataFrame, tokens: DataFrame,
              as_of: str = DEFAULT_AS_OF) -> dict[str, DataFrame]:
    """AG21: every dashboard part as its own DataFrame, from one scan per fact.

    Each fact is reduced to a small pre-aggregate at the grain its metrics
    need — (day, month, window flags, dimensions) with counts and sums — which
    is materialised once and rolled up into every part.  Distinct users per
    day (30 days) and per month (12 months) come from one GROUPING SETS
    distinct aggregation over the 12-month slice (the time filter is pushed
    into the scan).  Without materialising, Catalyst pushes each part's filter
    below the shared aggregate and every part rescans the fact table.
    """
    recent = (msgs.where((F.col("role") == "user") & after("created_at", as_of, "12 MONTHS"))
                  .select(F.when(after("created_at", as_of, "30 DAYS"), F.to_date("created_at")).alias("day"),
                          F.date_format("created_at", "yyyy-MM").alias("month"), "user_id"))
    ub, mb, tb, au = _materialise(
        users.groupBy(*_flags(as_of), "login_source", (F.col("banned") == F.lit(True)).alias("is_banned"))
             .agg(F.count(F.lit(1)).alias("n")),
        msgs.groupBy(*_flags(as_of), "role", "category", "feedback").agg(F.count(F.lit(1)).alias("n")),
        tokens.groupBy(*_flags(as_of), model_group("model").alias("model_group"))
              .agg(F.sum("total_tokens").alias("s"), F.count(F.lit(1)).alias("n")),
        recent.groupingSets([["day"], ["month"]], "day", "month")
              .agg(F.count_distinct("user_id").alias("count"), F.grouping_id().alias("gid")))

    n = F.col("n")

    def s_if(cond: Column, v: Column = n) -> Column:
        return zero_if_null(F.sum(F.when(cond, v)))

    fb = F.col("feedback")
    ai = mb.where(F.col("role") == "ai")
    usr = mb.where(F.col("role") == "user")
    return {
        "totals": ub.agg(
            zero_if_null(F.sum(n)).alias("total_users"),
            s_if(F.col("login_source") == "devonix").alias("users_via_devonix"),
            s_if(F.col("login_source") == "email").alias("users_via_email"),
            s_if(F.col("is_banned")).alias("banned_users"),
            s_if(F.col("f1")).alias("new_today"),
            s_if(F.col("f7")).alias("new_last_7_days"),
            s_if(F.col("f30")).alias("new_last_30_days")),
        "tokenTotals": tb.agg(
            zero_if_null(F.sum("s")).alias("total_tokens"),
            s_if(F.col("f1"), F.col("s")).alias("tokens_today"),
            s_if(F.col("f30"), F.col("s")).alias("tokens_last_30_days"),
            zero_if_null(F.sum(n)).alias("total_requests")),
        "feedbackTotals": ai.agg(
            s_if(fb == "up").alias("total_up"),
            s_if(fb == "down").alias("total_down"),
            s_if((fb == "up") & F.col("f1")).alias("up_today"),
            s_if((fb == "down") & F.col("f1")).alias("down_today"),
            s_if((fb == "up") & F.col("f30")).alias("up_last_30_days"),
            s_if((fb == "down") & F.col("f30")).alias("down_last_30_days")),
        "dailyUsers": ub.where("f30").groupBy("day").agg(F.sum(n).alias("count")).orderBy("day"),
        "dailyActiveUsers": (au.where(F.col("day").isNotNull() & (F.col("gid") == 1))
                               .select("day", "count").orderBy("day")),
        "dailyTokens": (tb.where("f30").groupBy("day")
                          .agg(zero_if_null(F.sum("s")).alias("count")).orderBy("day")),
        "dailyFeedback": (ai.where("f30").groupBy("day")
                            .agg(F.sum(n).alias("total"), s_if(fb == "up").alias("up"),
                                 s_if(fb == "down").alias("down"), s_if(fb.isNull()).alias("none"))
                            .orderBy("day")),
        "monthlyUsers": ub.where("f12").groupBy("month").agg(F.sum(n).alias("count")).orderBy("month"),
        "monthlyActiveUsers": (au.where(F.col("month").isNotNull() & (F.col("gid") == 2))
                                 .select("month", "count").orderBy("month")),
        "monthlyTokens": (tb.where("f12").groupBy("month")
                            .agg(zero_if_null(F.sum("s")).alias("count")).orderBy("month")),
        "topCategories": (usr.where(F.col("category").isNotNull()).groupBy("category")
                             .agg(F.sum(n).alias("count"))
                             .orderBy(F.col("count").desc(), F.col("category").asc()).limit(20)),
        "categoriesLast30Days": (usr.where(F.col("category").isNotNull() & F.col("f30"))
                                    .groupBy("category").agg(F.sum(n).alias("count"))
                                    .orderBy(F.col("count").desc(), F.col("category").asc()).limit(20)),
        "modelBreakdown": (tb.groupBy("model_group")
                             .agg(zero_if_null(F.sum(n)).alias("requests"),
                                  zero_if_null(F.sum("s")).alias("tokens"))
                             .orderBy(F.col("tokens").desc(), "model_group")),
    }


def dashboard_long(users: DataFrame, msgs: DataFrame, tokens: DataFrame,
                   as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """AG21 as one table (section, bucket, metric, value); see ``dashboard``."""
    return long_table(dashboard(users, msgs, tokens, as_of))


def long_table(d: dict[str, DataFrame]) -> DataFrame:
    """The parts of a dashboard as one table."""
    parts = [
        _long(d["totals"], "totals", None, ["total_users", "users_via_devonix", "users_via_email",
                                            "banned_users", "new_today", "new_last_7_days",
                                            "new_last_30_days"]),
        _long(d["tokenTotals"], "tokenTotals", None, ["total_tokens", "tokens_today",
                                                      "tokens_last_30_days", "total_requests"]),
        _long(d["feedbackTotals"], "feedbackTotals", None, ["total_up", "total_down", "up_today",
                                                            "down_today", "up_last_30_days",
                                                            "down_last_30_days"]),
        _long(d["dailyUsers"], "dailyUsers", F.col("day"), ["count"]),
        _long(d["dailyActiveUsers"], "dailyActiveUsers", F.col("day"), ["count"]),
        _long(d["dailyTokens"], "dailyTokens", F.col("day"), ["count"]),
        _long(d["dailyFeedback"], "dailyFeedback", F.col("day"), ["total", "up", "down", "none"]),
        _long(d["monthlyUsers"], "monthlyUsers", F.col("month"), ["count"]),
        _long(d["monthlyActiveUsers"], "monthlyActiveUsers", F.col("month"), ["count"]),
        _long(d["monthlyTokens"], "monthlyTokens", F.col("month"), ["count"]),
        _long(d["topCategories"], "topCategories", F.col("category"), ["count"]),
        _long(d["categoriesLast30Days"], "categoriesLast30Days", F.col("category"), ["count"]),
        _long(d["modelBreakdown"], "modelBreakdown", F.col("model_group"), ["requests", "tokens"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ JN1, JN2

def audit_with_user(audit: DataFrame, users: DataFrame) -> DataFrame:
    """JN1: audit rows with the target user's names (NULL when the user is gone).

    users is keyed by id, so the join never multiplies audit rows; AQE turns
    it into a broadcast join when the filtered users side is small.
    """
    u = users.select(F.col("id").alias("uid"), "first_name", "last_name", "email")
    j = audit.join(u, audit.target_user_id == u.uid, "left")
    return j.select("id", "action", "target_user_id", "ip", "created_at", "first_name", "last_name", "email")


def users_with_usage(users: DataFrame, sessions: DataFrame, tokens: DataFrame) -> DataFrame:
    """JN2: each user with session count and token sum (0 when none).

    The correlated scalar subqueries become two pre-aggregations by user_id
    (partial aggregation before the shuffle) and two left joins on the key.
    """
    sc = sessions.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("session_count"))
    tt = tokens.groupBy(F.col("user_id").alias("id")).agg(F.sum("total_tokens").alias("tt"))
    cols = ["id", "first_name", "last_name", "email", "login_source", "plan", "profile_picture",
            "banned", "ban_reason", "banned_at", "suspended_until", "suspend_reason", "created_at"]
    j = users.select(*cols).join(sc, "id", "left").join(tt, "id", "left")
    return j.select(*cols, zero_if_null(F.col("session_count")).alias("session_count"),
                    zero_if_null(F.col("tt")).alias("total_tokens"))


# ------------------------------------------------------------------ PF1-PF6, PF11

def user_search(users: DataFrame, search: str | None) -> DataFrame:
    """PF1: ILIKE '%s%' on first/last name or email; '%'/'_' in s stay wildcards.

    The empty-search branch is decided in Python, so the filter is simply
    absent (what constant folding would do for ``'' = ''``).
    """
    s = js_trim_py(search)
    if s == "":
        return users
    p = f"%{s}%"
    return users.where(F.col("first_name").ilike(p) | F.col("last_name").ilike(p) | F.col("email").ilike(p))


def user_filter(users: DataFrame, source: str | None = "all", banned: str | None = "any") -> DataFrame:
    """PF2: login source ('all' or exact) and banned ('any'/'true'/'false'; other → no rows)."""
    source = (source or "all").lower()
    banned = (banned or "any").lower()
    out = users
    if source != "all":
        out = out.where(F.col("login_source") == source)
    if banned == "true":
        out = out.where(F.col("banned") == F.lit(True))
    elif banned == "false":
        out = out.where(F.col("banned") == F.lit(False))
    elif banned != "any":
        out = out.where(F.lit(False))
    return out


def point_lookup(table: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """PF4 (batch form): rows whose ``on`` value appears in ``keys``."""
    return table.join(keys.select(on).distinct(), on, "left_semi")


def valid_ids(ids: DataFrame, col: str = "id") -> DataFrame:
    """Keep ids that are positive integers (``Number(x)`` integral and > 0)."""
    v = F.col(col).cast("string").try_cast("double")
    return (ids.where(v.isNotNull() & (v > 0) & (v == F.floor(v)))
               .select(v.cast("bigint").alias("id")).distinct())


def drop_ids(audit: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PF6/ST5: remove audit rows whose id is in ``ids``; also return the deleted count."""
    good = valid_ids(ids)
    kept = audit.join(good, "id", "left_anti")
    deleted = audit.join(good, "id", "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return kept, deleted


# Fixed value: the sign-in pattern; \z, since $ would let a final newline pass.
EMAIL_RE = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"


def valid_email(c: Column | str) -> Column:
    """PF7: the sign-in e-mail pattern."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(EMAIL_RE), F.lit(False))


def session_search(sessions: DataFrame, q: str | None) -> DataFrame:
    """PF11: case-insensitive substring on title ('%' is literal here)."""
    s = (q or "").strip()
    if not s:
        return sessions
    return sessions.where(F.lower(F.col("title")).contains(s.lower()))


# ------------------------------------------------------------------ SL1, SL2

def clamp_page(page) -> int:
    """``Math.max(1, parseInt(page) || 1)``."""
    return max(1, _js_int(page) or 1)


def clamp_limit(limit, default: int = 25, lo: int = 1, hi: int = 100) -> int:
    """``Math.min(hi, Math.max(lo, parseInt(limit) || default))``."""
    return min(hi, max(lo, _js_int(limit) or default))


def _js_int(x) -> int | None:
    import re
    if x is None:
        return None
    m = re.match(r"^\s*([+-]?[0-9]+)", str(x))
    return int(m.group(1)) if m else None


def paginate(df: DataFrame, order: list[Column], page, limit) -> tuple[DataFrame, DataFrame]:
    """SL2: one page of ``df`` plus (total, page, limit, total_pages).

    OFFSET paging needs a global order; Spark plans ``orderBy().offset().limit()``
    as a top-(offset+limit) per partition, so shallow pages never sort the
    whole table.  Deep pages should use keyset paging (filter on the last key).
    """
    p = clamp_page(page)
    lim = int(limit)
    rows = df.orderBy(*order).offset((p - 1) * lim).limit(lim)
    meta = df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(p).alias("page"), F.lit(lim).alias("limit"),
        F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(lim))).cast("bigint").alias("total_pages"))
    return rows, meta


def keyset_page(df: DataFrame, order: list[tuple[str, bool]], after: tuple | None, limit: int) -> DataFrame:
    """SL2 for deep pages: the ``limit`` rows after the key ``after`` in ``order``.

    ``order`` is [(column, descending)]; the last column must be unique (e.g.
    id).  The seek predicate is a filter Spark pushes toward the scan, so a
    deep page costs a top-``limit`` per partition instead of sorting and
    skipping ``offset`` rows.  NULL sorts above every value, as in Postgres
    (first when descending, last when ascending).
    """
    out = df
    if after is not None:
        cond = None
        for i in range(len(order) - 1, -1, -1):
            c, desc = order[i]
            v = F.col(c)
            if after[i] is None:
                step = v.isNotNull() if desc else F.lit(False)
                same = v.isNull()
            else:
                step = F.coalesce(v < F.lit(after[i]), F.lit(False)) if desc else v.isNull() | (v > F.lit(after[i]))
                same = F.coalesce(v == F.lit(after[i]), F.lit(False))
            cond = step if cond is None else (step | (same & cond))
        out = out.where(cond)
    return out.orderBy(*[F.col(c).desc_nulls_first() if d else F.col(c).asc_nulls_last() for c, d in order]).limit(limit)


def audit_page(audit: DataFrame, users: DataFrame, page=1, limit: int = 30) -> tuple[DataFrame, DataFrame]:
    """JN1 + SL2: newest-first audit page (Postgres DESC = NULLS FIRST, id tie-break)."""
    order = [pg_desc("created_at"), F.col("id").desc()]
    rows, meta = paginate(audit, order, page, limit)
    return audit_with_user(rows, users).orderBy(*order), meta


def users_page(users: DataFrame, sessions: DataFrame, tokens: DataFrame, page=1, limit=25,
               search: str | None = None, source: str | None = "all",
               banned: str | None = "any") -> tuple[DataFrame, DataFrame]:
    """PF1 + PF2 + JN2 + SL2: the admin user list."""
    f = user_filter(user_search(users, search), source, banned)
    order = [pg_desc("created_at"), F.col("id").desc()]
    rows, meta = paginate(f, order, page, clamp_limit(limit))
    # At most 100 users are on a page: the facts are reduced to theirs before they are summed.
    mine = F.broadcast(rows.select(F.col("id").alias("user_id")))
    j = users_with_usage(rows, sessions.join(mine, "user_id", "left_semi"), tokens.join(mine, "user_id", "left_semi"))
    return j.orderBy(*order), meta
