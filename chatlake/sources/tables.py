"""Table scans (SC1) and the application tables derived from the driver tables.

The application data model has eight tables (users, app_settings, email_otps,
dream_sessions, dream_messages, knowledge_chunks, token_usage, audit_log).
The test data ships TPC-H-like driver tables instead, so each application
table here is a pure projection/aggregation of driver tables.  All of them are
lazy DataFrames: Catalyst prunes the columns a query does not use and pushes
filters into the parquet scan, so deriving a view costs nothing extra.

Timestamps stay TIMESTAMP_NTZ everywhere (parquet ``timestamp[us]`` without a
zone loads as NTZ), so no result depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMAS: dict[str, T.StructType] = {
    "region": T.StructType([T.StructField("r_regionkey", T.IntegerType()),
                            T.StructField("r_name", T.StringType())]),
    "nation": T.StructType([T.StructField("n_nationkey", T.IntegerType()),
                            T.StructField("n_name", T.StringType()),
                            T.StructField("n_regionkey", T.IntegerType())]),
    "customer": T.StructType([T.StructField("c_custkey", T.LongType()),
                              T.StructField("c_name", T.StringType()),
                              T.StructField("c_nationkey", T.IntegerType()),
                              T.StructField("c_acctbal", T.DoubleType()),
                              T.StructField("c_mktsegment", T.StringType())]),
    "supplier": T.StructType([T.StructField("s_suppkey", T.LongType()),
                              T.StructField("s_name", T.StringType()),
                              T.StructField("s_nationkey", T.IntegerType()),
                              T.StructField("s_acctbal", T.DoubleType())]),
    "part": T.StructType([T.StructField("p_partkey", T.LongType()),
                          T.StructField("p_name", T.StringType()),
                          T.StructField("p_brand", T.StringType()),
                          T.StructField("p_type", T.StringType()),
                          T.StructField("p_size", T.IntegerType()),
                          T.StructField("p_retailprice", T.DoubleType())]),
    "orders": T.StructType([T.StructField("o_orderkey", T.LongType()),
                            T.StructField("o_custkey", T.LongType()),
                            T.StructField("o_orderstatus", T.StringType()),
                            T.StructField("o_totalprice", T.DoubleType()),
                            T.StructField("o_orderdate", T.TimestampNTZType()),
                            T.StructField("o_orderpriority", T.StringType())]),
    "lineitem": T.StructType([T.StructField("l_orderkey", T.LongType()),
                              T.StructField("l_partkey", T.LongType()),
                              T.StructField("l_suppkey", T.LongType()),
                              T.StructField("l_linenumber", T.IntegerType()),
                              T.StructField("l_quantity", T.DoubleType()),
                              T.StructField("l_extendedprice", T.DoubleType()),
                              T.StructField("l_discount", T.DoubleType()),
                              T.StructField("l_tax", T.DoubleType()),
                              T.StructField("l_returnflag", T.StringType()),
                              T.StructField("l_linestatus", T.StringType()),
                              T.StructField("l_shipdate", T.TimestampNTZType())]),
    "events": T.StructType([T.StructField("event_id", T.LongType()),
                            T.StructField("ts", T.TimestampNTZType()),
                            T.StructField("user_id", T.LongType()),
                            T.StructField("event_type", T.StringType()),
                            T.StructField("value", T.DoubleType()),
                            T.StructField("props", T.StringType())]),
    "documents": T.StructType([T.StructField("doc_id", T.LongType()),
                               T.StructField("text", T.StringType()),
                               T.StructField("lang", T.StringType()),
                               T.StructField("source", T.StringType()),
                               T.StructField("n_chars", T.LongType())]),
    "embeddings": T.StructType([T.StructField("vec_id", T.LongType()),
                                T.StructField("embedding", T.ArrayType(T.FloatType())),
                                T.StructField("label", T.IntegerType())]),
    "pages": T.StructType([T.StructField("page_id", T.LongType()),
                           T.StructField("url", T.StringType()),
                           T.StructField("html", T.StringType())]),
    "benchmark": T.StructType([T.StructField("item_id", T.LongType()),
                               T.StructField("text", T.StringType())]),
    "labels": T.StructType([T.StructField("doc_id", T.LongType()),
                            T.StructField("quality", T.IntegerType()),
                            T.StructField("toxic", T.IntegerType())]),
    "conversations": T.StructType([T.StructField("conv_id", T.LongType()),
                                   T.StructField("turn", T.LongType()),
                                   T.StructField("role", T.StringType()),
                                   T.StructField("text", T.StringType())]),
}

# Fixed value: the "now" every checked query is evaluated at.
DEFAULT_AS_OF = "2024-01-31 00:00:00"
# Fixed value: the "now" of the lineitem-sized token table (bench form).
BIG_AS_OF = "2001-08-02 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """SC1: scan one driver table with its declared schema (no inference)."""
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def load_stream(spark: SparkSession, path: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """SC1 (stream): the same table as a file stream; ``path`` is a folder of parquet files.

    ``pathGlobFilter`` picks the table's file(s), so a folder holding all
    tables (like the test data) works as well as a folder of one table.
    """
    r = spark.readStream.schema(RAW_SCHEMAS[name]).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def ts_lit(value: str) -> Column:
    """A TIMESTAMP_NTZ literal, independent of ``spark.sql.timestampType``."""
    return F.expr(f"TIMESTAMP_NTZ '{value}'")


def _plus_days(ts: Column, n: Column) -> Column:
    return ts + F.make_dt_interval(n.cast("int"))


def _k(props: Column) -> Column:
    return F.concat(F.lit("k"), F.get_json_object(props, "$.k"))


# ---------------------------------------------------------------- app tables

def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users_from(load(spark, sf_dir, "customer"))


def users_from(c: DataFrame) -> DataFrame:
    """users as a projection of a customer DataFrame (batch or stream)."""
    dev = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.when(dev, "devonix").otherwise("email").alias("login_source"),
        F.when(dev, F.col("c_custkey") + 100000).alias("devonix_user_id"),
        F.col("c_name").alias("first_name"),
        F.col("c_mktsegment").alias("last_name"),
        F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(""))),
                 F.lit("@example.com")).alias("email"),
        F.lit(None).cast("string").alias("phone"),
        F.lit(None).cast("string").alias("profile_picture"),
        F.lit("free").alias("plan"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit(None).cast("boolean"))
         .otherwise(F.col("c_acctbal") < 0).alias("banned"),
        F.lit(None).cast("string").alias("ban_reason"),
        F.lit(None).cast("timestamp_ntz").alias("banned_at"),
        F.lit(None).cast("timestamp_ntz").alias("suspended_until"),
        F.lit(None).cast("string").alias("suspend_reason"),
        F.lit(None).cast("timestamp_ntz").alias("last_login_at"),
        _plus_days(ts_lit("2023-02-01 12:00:00"), F.col("c_custkey") % 365).alias("created_at"),
    )


def dream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dream_messages_from(load(spark, sf_dir, "events"))


def dream_messages_from(e: DataFrame) -> DataFrame:
    """dream_messages as a projection of an events DataFrame (batch or stream)."""
    even = F.col("event_id") % 2 == 0
    odd = F.col("event_id") % 2 == 1
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("session_id"),
        F.when(even, "user").otherwise("ai").alias("role"),
        F.lit("").alias("content"),
        F.when(even & (F.col("event_id") % 7 != 0), F.col("event_type")).alias("category"),
        F.when(even & (F.col("event_id") % 5 != 0), _k(F.col("props"))).alias("entity"),
        F.when(odd & (F.col("value") >= 60), "up")
         .when(odd & (F.col("value") < 5), "down").alias("feedback"),
        F.col("ts").alias("created_at"),
    )


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_usage_from(load(spark, sf_dir, "events"))


def token_usage_from(e: DataFrame) -> DataFrame:
    """token_usage as a projection of an events DataFrame (batch or stream)."""
    m = F.col("event_id") % 8
    p = F.floor("value").cast("bigint")
    c = F.floor(F.col("value") * 3).cast("bigint")
    return e.where(F.col("event_id") % 2 == 1).select(
        F.col("event_id").alias("id"), F.col("user_id"), F.col("event_id").alias("message_id"),
        F.when(m == 1, "openrouter:m1").when(m == 3, "synthesis:m2").when(m == 5, "m3").alias("model"),
        p.alias("prompt_tokens"), c.alias("completion_tokens"), (p + c).alias("total_tokens"),
        F.col("ts").alias("created_at"),
    )


def token_usage_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem-sized token table for the bench (as_of = BIG_AS_OF)."""
    l = load(spark, sf_dir, "lineitem")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = l.join(o, l.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("o_custkey").alias("user_id"), F.col("l_orderkey").alias("message_id"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") == "A", "openrouter:m1")
         .when(F.col("l_returnflag") == "N", "synthesis:m2").otherwise("m3").alias("model"),
        F.floor("l_quantity").cast("bigint").alias("total_tokens"),
        F.col("l_shipdate").alias("created_at"),
    )


def dream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return (e.groupBy("user_id", F.dayofmonth("ts").alias("d"))
             .agg(F.min("event_type").alias("title"), F.min("ts").alias("created_at"))
             .select((F.col("user_id") * 100 + F.col("d")).alias("id"), "user_id", "title", "created_at"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where(F.col("event_type") == "error")
    return e.select(
        F.col("event_id").alias("id"),
        F.when(F.col("value") < 20, "ban_user").otherwise("suspend_user").alias("action"),
        (F.col("user_id") * 20).alias("target_user_id"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 16).cast("string")).alias("ip"),
        F.col("ts").alias("created_at"),
    )


def knowledge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with vectors: embeddings joined to documents on id.

    ``created_at`` is derived (start of 2024 + id % 30 days) so the summary
    query has a time column to take the max of.
    """
    e = load(spark, sf_dir, "embeddings")
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    j = e.join(d, e.vec_id == d.doc_id)
    return j.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("t"), F.col("label").cast("string")).alias("tradition"),
        F.col("source").alias("source_ref"),
        F.col("text").alias("content"),
        F.col("embedding"),
        _plus_days(ts_lit("2024-01-01 00:00:00"), F.col("vec_id") % 30).alias("created_at"),
    )


def send_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 16).cast("string")).alias("ip"),
        F.col("ts").alias("created_at"),
    )


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn",
                    F.when(F.col("role") == "assistant", "ai").otherwise(F.col("role")).alias("role"),
                    "text")


def sso_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").where((F.col("c_custkey") % 10).isin(0, 1))
    k = F.col("c_custkey")
    return c.select(
        F.when(k % 10 == 1, k + 900000).otherwise(k + 100000).alias("devonix_user_id"),
        F.when(k % 30 == 0, "").otherwise(F.concat(F.lit("F"), k.cast("string"))).alias("first_name"),
        F.lit("L").alias("last_name"),
        F.when(k % 10 == 1, F.concat(F.lit("new"), k.cast("string"), F.lit("@example.com")))
         .when(k % 20 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(""))),
                             F.lit("@example.com"))).alias("email"),
        F.lit(None).cast("string").alias("phone"),
        ts_lit("2024-01-30 00:00:00").alias("ts"),
    )


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback_events_from(dream_messages(spark, sf_dir))


def feedback_events_from(msgs: DataFrame) -> DataFrame:
    """feedback_events from a dream_messages DataFrame (batch or stream)."""
    m = msgs.where(F.col("id") % 3 == 0)
    seq = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seq")
    x = m.select("id", "user_id", "created_at", seq)
    r = (F.col("id") + F.col("seq")) % 3
    return x.select(
        (F.col("id") * 10 + F.col("seq")).alias("id"),
        F.col("id").alias("message_id"),
        (F.col("user_id") + F.when((F.col("seq") == 2) & (F.col("id") % 5 == 0), 1).otherwise(0)).alias("user_id"),
        F.when(r == 0, "up").when(r == 1, "down").alias("feedback"),
        F.col("created_at").alias("message_ts"),
        F.col("seq").cast("int").alias("seq"),
    )


def admin_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = users(spark, sf_dir).where(F.col("id") % 7 == 0).select("id")
    x = u.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    r = (F.col("id") + F.col("seq")) % 5
    return x.select(
        (F.col("id") * 10 + F.col("seq")).alias("seq"),
        F.col("id").alias("target_id"),
        F.when(r == 0, "ban").when(r == 1, "unban").when(r == 2, "suspend").when(r == 3, "unsuspend")
         .otherwise(F.when(F.col("id") % 3 == 0, "delete").otherwise("ban")).alias("action"),
        F.when(F.col("id") % 2 == 0, "spam").otherwise("").alias("reason"),
        (F.col("id") % 2).cast("int").alias("months"),
        (F.col("id") % 3).cast("int").alias("days"),
    )


def app_settings(spark: SparkSession) -> DataFrame:
    """The one seeded settings row (schema seed)."""
    return spark.createDataFrame([("maintenance_mode", "false")], "key string, value string")


VIEWS = {
    "users": users, "dream_messages": dream_messages, "token_usage": token_usage,
    "token_usage_big": token_usage_big, "dream_sessions": dream_sessions, "audit_log": audit_log,
    "knowledge_chunks": knowledge_chunks, "send_log": send_log, "chat_turns": chat_turns,
    "sso_payloads": sso_payloads, "feedback_events": feedback_events,
    "admin_actions": admin_actions,
}
