"""Usage figures kept by day: stored partials, refreshed for the days that changed.

Every fact is reduced to partials of one day each, small tables partitioned by
month.  New, late or deleted rows change the days that they lie in; ``refresh``
reads those days of the facts only and replaces their partials, so a late row
adds itself to its day and a deleted user's rows leave theirs.  Sums, counts and
groups roll up from the partials.  Distinct users do too, without a second
distinct count over the facts: a day's users are exact bitmaps (one bit for each
user number, 32,768 to a bucket), and bitmaps of days merge into months.

A window ``created_at > as_of - interval`` begins inside a day.  Its whole days
come from the store; of the day that it begins in, the rows after the instant
are read from the facts.

Rows without a time are kept under the day NULL: they count in all-time totals
and in no window.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.operators import metrics as M
from chatlake.sources.tables import DEFAULT_AS_OF, ts_lit

Facts = dict[str, DataFrame]


def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


def _user_partials(users: DataFrame, *by: Column | str) -> DataFrame:
    return users.groupBy(*by, "login_source", (F.col("banned") == F.lit(True)).alias("is_banned")).agg(_n())


def _message_partials(msgs: DataFrame, *by: Column | str) -> DataFrame:
    return msgs.groupBy(*by, "role", "category", "feedback").agg(_n())


def _token_partials(tokens: DataFrame, *by: Column | str) -> DataFrame:
    return tokens.groupBy(*by, M.model_group("model").alias("model_group")).agg(F.sum("total_tokens").alias("s"), _n())


def _user_token_partials(tokens: DataFrame, *by: Column | str) -> DataFrame:
    return tokens.groupBy(*by, "user_id").agg(F.sum("total_tokens").alias("s"), _n())


def _active_partials(msgs: DataFrame, *by: Column | str) -> DataFrame:
    """Each day's users with a user message: a bitmap for each bucket of user numbers.

    Messages without a user have the bucket NULL and an empty bitmap: a day of them counts 0.
    """
    who = F.col("user_id").cast("long")
    return (msgs.where(F.col("role") == "user")
            .groupBy(*by, F.bitmap_bucket_number(who).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(who)).alias("bits"), _n()))


#: Stored table: its fact, its partials, and its columns besides the day.
TABLES: dict[str, tuple[str, Callable[..., DataFrame], str]] = {
    "users": ("users", _user_partials, "login_source string, is_banned boolean, n long"),
    "messages": ("messages", _message_partials, "role string, category string, feedback string, n long"),
    "tokens": ("tokens", _token_partials, "model_group string, s long, n long"),
    "user_tokens": ("tokens", _user_token_partials, "user_id long, s long, n long"),
    "actives": ("messages", _active_partials, "bucket long, bits binary, n long"),
}


def of_days(fact: DataFrame, days: list[dt.date | None]) -> DataFrame:
    """Rows of some days, as time ranges that reach the scan."""
    at = F.col("created_at")
    conditions = [at.isNull() if d is None else (at >= ts_lit(f"{d}")) & (at < ts_lit(f"{d + dt.timedelta(days=1)}"))
                  for d in days]
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return fact.where(out)


def changed_days(*rows: DataFrame) -> list[dt.date | None]:
    """The days that new, late or deleted fact rows lie in (one small row each)."""
    days = {r["day"] for df in rows for r in df.select(F.to_date("created_at").alias("day")).distinct().collect()}
    return sorted(days, key=lambda d: (d is not None, d))


class DayStore:
    """The partials below one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        """A stored table without the rows that only mark a refreshed day."""
        return (self.spark.read.schema(f"{TABLES[name][2]}, day date, month string").parquet(f"{self.path}/{name}")
                .where(F.col("n") > 0).drop("month"))

    def refresh(self, facts: Facts, days: list[dt.date | None] | None = None) -> None:
        """Recompute ``days`` (None: all) from ``facts`` and replace them.

        Days are stored in folders of months; the partials of a touched month's other days are carried over.
        """
        if days is not None and not days:
            return
        month = F.coalesce(F.date_format("day", "yyyy-MM"), F.lit("none"))
        for name, (fact, partials, columns) in TABLES.items():
            path, columns = f"{self.path}/{name}", [c.split()[0] for c in columns.split(", ")] + ["day"]
            day = F.to_date("created_at").alias("day")
            rows = partials(facts[fact] if days is None else of_days(facts[fact], days), day).select(*columns)
            if days is not None:
                marks = self.spark.createDataFrame([(d,) for d in days], "day date")  # a month that lost all rows
                marks = marks.withColumn("n", F.lit(0).cast("long"))
                months = {"none" if d is None else f"{d:%Y-%m}" for d in days}
                kept = (self.spark.read.schema(f"{TABLES[name][2]}, day date, month string").parquet(path)
                        .where(F.col("month").isin(*months)))
                for d in days:
                    kept = kept.where(~F.col("day").eqNullSafe(F.lit(d).cast("date")))
                rows = rows.unionByName(marks, allowMissingColumns=True).unionByName(kept.select(*columns))
            # A month's rows lie in a few files, however many tasks grouped them.
            spread = F.pmod(F.xxhash64(columns[0], "day"), F.lit(8))
            (rows.withColumn("month", month).repartition("month", spread).write.mode("overwrite")
             .option("partitionOverwriteMode", "static" if days is None else "dynamic")
             .partitionBy("month").parquet(path))

    def flagged(self, name: str, facts: Facts, as_of: str, windows: list[str], every: bool = False) -> DataFrame:
        """Partials once for each of ``windows`` (intervals before ``as_of``) that they lie in, named in ``part``.

        One read of the store and one of the facts' edge days.  With ``every`` also all partials, as the part ''.
        """
        fact, partials, _ = TABLES[name]
        at, day = F.col("created_at"), F.col("day")
        cuts = {w: M.since(as_of, w) for w in windows}
        whole = [F.when(day > F.to_date(cut), F.lit(w)) for w, cut in cuts.items()] + [F.lit("")] * every
        on_edge = {w: (at > cut) & (at < F.date_trunc("DAY", cut).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
                   for w, cut in cuts.items()}
        any_edge = F.lit(False)
        for c in on_edge.values():
            any_edge = any_edge | c
        parts = lambda flags: F.explode(F.array_compact(F.array(*flags)))
        edge = (facts[fact].where(any_edge).withColumn("part", parts([F.when(c, F.lit(w)) for w, c in on_edge.items()]))
                .withColumn("day", F.to_date("created_at")))
        return self.read(name).withColumn("part", parts(whole)).unionByName(partials(edge, "day", "part"))

    # ------------------------------------------------------------ figures

    def daily_actives(self, facts: Facts, as_of: str = DEFAULT_AS_OF) -> DataFrame:
        """AG5: distinct users with a user message per day (30 days)."""
        return (self.flagged("actives", facts, as_of, ["30 DAYS"]).groupBy("day", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
                .groupBy("day").agg(F.sum(F.bitmap_count("bits")).alias("count")).orderBy("day"))

    def monthly_actives(self, facts: Facts, as_of: str = DEFAULT_AS_OF) -> DataFrame:
        """AG9: distinct users with a user message per month (12 months), from the days' bitmaps."""
        month = F.date_format("day", "yyyy-MM").alias("month")
        return (self.flagged("actives", facts, as_of, ["12 MONTHS"]).groupBy(month, "bucket")
                .agg(F.bitmap_or_agg("bits").alias("bits"))
                .groupBy("month").agg(F.sum(F.bitmap_count("bits")).alias("count")).orderBy("month"))

    def user_token_summary(self, facts: Facts, as_of: str = DEFAULT_AS_OF) -> DataFrame:
        """AG15 from one row for each user and day."""
        rows, part = self.flagged("user_tokens", facts, as_of, ["30 DAYS"], every=True), F.col("part")
        return rows.groupBy("user_id").agg(
            M.zero_if_null(F.sum(F.when(part == "", F.col("s")))).alias("total_tokens"),
            M.zero_if_null(F.sum(F.when(part != "", F.col("s")))).alias("tokens_last_30_days"),
            M.zero_if_null(F.sum(F.when(part == "", F.col("n")))).alias("total_requests"))

    def dashboard(self, facts: Facts, as_of: str = DEFAULT_AS_OF) -> dict[str, DataFrame]:
        """AG21: every part from the stored days."""
        n, s, part, fb = F.col("n"), F.col("s"), F.col("part"), F.col("feedback")

        def s_if(cond: Column, v: Column = n) -> Column:
            return M.zero_if_null(F.sum(F.when(cond, v)))

        def top(rows: DataFrame) -> DataFrame:
            return (rows.groupBy("category").agg(F.sum(n).alias("count"))
                    .orderBy(F.col("count").desc(), F.col("category").asc()).limit(20))

        month = F.date_format("day", "yyyy-MM").alias("month")
        users = self.flagged("users", facts, as_of, ["1 DAY", "7 DAYS", "30 DAYS", "12 MONTHS"], every=True)
        tokens = self.flagged("tokens", facts, as_of, ["1 DAY", "30 DAYS", "12 MONTHS"], every=True)
        msgs = self.flagged("messages", facts, as_of, ["1 DAY", "30 DAYS"], every=True)
        ai = msgs.where(F.col("role") == "ai")
        labelled = msgs.where((F.col("role") == "user") & F.col("category").isNotNull())
        up, down, every = fb == "up", fb == "down", part == ""
        return {
            "totals": users.agg(
                s_if(every).alias("total_users"),
                s_if(every & (F.col("login_source") == "devonix")).alias("users_via_devonix"),
                s_if(every & (F.col("login_source") == "email")).alias("users_via_email"),
                s_if(every & F.col("is_banned")).alias("banned_users"),
                s_if(part == "1 DAY").alias("new_today"),
                s_if(part == "7 DAYS").alias("new_last_7_days"),
                s_if(part == "30 DAYS").alias("new_last_30_days")),
            "tokenTotals": tokens.agg(
                s_if(every, s).alias("total_tokens"),
                s_if(part == "1 DAY", s).alias("tokens_today"),
                s_if(part == "30 DAYS", s).alias("tokens_last_30_days"),
                s_if(every).alias("total_requests")),
            "feedbackTotals": ai.agg(
                s_if(every & up).alias("total_up"),
                s_if(every & down).alias("total_down"),
                s_if((part == "1 DAY") & up).alias("up_today"),
                s_if((part == "1 DAY") & down).alias("down_today"),
                s_if((part == "30 DAYS") & up).alias("up_last_30_days"),
                s_if((part == "30 DAYS") & down).alias("down_last_30_days")),
            "dailyUsers": users.where(part == "30 DAYS").groupBy("day").agg(F.sum(n).alias("count")).orderBy("day"),
            "dailyActiveUsers": self.daily_actives(facts, as_of),
            "dailyTokens": (tokens.where(part == "30 DAYS").groupBy("day").agg(M.zero_if_null(F.sum(s)).alias("count"))
                            .orderBy("day")),
            "dailyFeedback": (ai.where(part == "30 DAYS").groupBy("day")
                              .agg(F.sum(n).alias("total"), s_if(up).alias("up"), s_if(down).alias("down"),
                                   s_if(fb.isNull()).alias("none")).orderBy("day")),
            "monthlyUsers": users.where(part == "12 MONTHS").groupBy(month).agg(F.sum(n).alias("count")).orderBy("month"),
            "monthlyActiveUsers": self.monthly_actives(facts, as_of),
            "monthlyTokens": (tokens.where(part == "12 MONTHS").groupBy(month).agg(M.zero_if_null(F.sum(s)).alias("count"))
                              .orderBy("month")),
            "topCategories": top(labelled.where(every)),
            "categoriesLast30Days": top(labelled.where(part == "30 DAYS")),
            "modelBreakdown": (tokens.where(every).groupBy("model_group")
                               .agg(M.zero_if_null(F.sum(n)).alias("requests"), M.zero_if_null(F.sum(s)).alias("tokens"))
                               .orderBy(F.col("tokens").desc(), "model_group")),
        }


# ---------------------------------------------------------------- numbers for other ids

def number_ids(ids: DataFrame, known: DataFrame | None = None, key: str = "user_id") -> DataFrame:
    """(key, number): ``known`` numbers kept, and the next ones for new ids, so that ids of any type have bits.

    New ids are range-partitioned and numbered from their partition's offset; the offsets are one small row for
    each partition.
    """
    new = ids.where(F.col(key).isNotNull()).select(key).distinct()
    first = 1
    if known is not None:
        new = new.join(known.select(key), key, "left_anti")
        first = 1 + (known.agg(F.max("number")).first()[0] or 0)
    from chatlake.session import checkpoint_dir
    checkpoint_dir(ids.sparkSession)
    placed = (new.repartitionByRange(F.col(key)).sortWithinPartitions(key)
              .withColumn("at", F.monotonically_increasing_id()).checkpoint(eager=True))
    part, place = F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], first
    for p, size in sizes:
        offsets.append((p, total))
        total += size
    before = ids.sparkSession.createDataFrame(offsets, "part long, before long")
    out = (placed.withColumn("part", part).join(F.broadcast(before), "part")
           .select(key, (F.col("before") + place).alias("number")))
    return out if known is None else known.select(key, "number").unionByName(out)
