"""Account and event-state maintenance as snapshot jobs.

The application mutates rows one request at a time (UPDATE/INSERT/DELETE).
Here each job takes the current snapshot plus a batch of changes and returns
the next snapshot (and reports), built from joins, anti joins and per-key
``max_by`` aggregates.  ``max_by`` is a partial (map-side) aggregate, so a key
with a huge number of events does not pile up in one task the way a
``row_number`` window over that key would.  Parquet has no MERGE, so callers
write the new snapshot to a new path and swap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.functions.scalars import suspension_end
from chatlake.functions.semantics import js_int_or, nullif_empty
from chatlake.sources.tables import DEFAULT_AS_OF, ts_lit

# New user ids: SSO inserts get NEW_SSO_ID_BASE + devonix id (unique per payload
# after dedupe, no global numbering pass); e-mail inserts get a 63-bit hash.
NEW_SSO_ID_BASE = 10_000_000_000
ACTIONS = ["delete", "ban", "unban", "suspend", "unsuspend"]


def _latest(df: DataFrame, key: str | list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Latest row per key by ``order`` (max_by over a struct, skew-safe).

    Ties in ``order`` are broken by the value columns, so the pick is the same
    when a partition is recomputed after an executor loss.
    """
    keys = [key] if isinstance(key, str) else key
    tie = [c for c in cols if c not in order]
    pick = F.max_by(F.struct(*cols), F.struct(*order, *tie)).alias("_l")
    return df.groupBy(*keys).agg(pick).select(*keys, "_l.*")


# ------------------------------------------------------------------ ID1

def merge_identities(users: DataFrame, sso: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ID1: apply verified SSO sign-ins; returns (next users snapshot, outcome per payload).

    Per payload (latest per devonix id): match by devonix id → update names
    (blank → NULL), e-mail/phone ``COALESCE(new, old)``, last_login; else match
    by e-mail → also link the devonix id, keep e-mail; else insert.  A banned
    match is rejected.  A change that would leave two rows with one e-mail
    (UNIQUE) is reported as ``conflict`` and not applied.
    """
    s = _latest(sso.where(F.col("devonix_user_id").isNotNull()), "devonix_user_id", ["ts"],
                ["ts", "first_name", "last_name", "email", "phone"])
    s = s.select("devonix_user_id", "ts", nullif_empty("first_name").alias("fn"),
                 nullif_empty("last_name").alias("ln"))
    # Each payload is applied in turn, so the last non-blank e-mail and phone hold.
    held = lambda c: F.max_by(nullif_empty(c), F.when(nullif_empty(c).isNotNull(), F.struct("ts", c)))
    s = s.join(sso.groupBy("devonix_user_id").agg(held("email").alias("em"), held("phone").alias("ph")),
               "devonix_user_id")
    u = users.select("id", "devonix_user_id", "email", "phone", "banned")
    by_id = s.join(u.where(F.col("devonix_user_id").isNotNull()), "devonix_user_id")
    rest = s.join(by_id.select("devonix_user_id"), "devonix_user_id", "left_anti")
    by_em = (rest.where(F.col("em").isNotNull())
                 .join(u.select("id", F.col("email").alias("em"), "phone", "banned"), "em"))
    ins = rest.join(by_em.select("devonix_user_id"), "devonix_user_id", "left_anti")

    banned = F.coalesce(F.col("banned"), F.lit(False))
    cand = (by_id.select("devonix_user_id", "id", "ts", "fn", "ln", F.coalesce("em", "email").alias("new_email"),
                         F.coalesce("ph", "phone").alias("new_phone"),
                         F.when(banned, "rejected").otherwise("updated").alias("outcome"))
            .unionByName(by_em.select("devonix_user_id", "id", "ts", "fn", "ln", F.col("em").alias("new_email"),
                                      F.coalesce("ph", "phone").alias("new_phone"),
                                      F.when(banned, "rejected").otherwise("linked").alias("outcome")))
            .unionByName(ins.select("devonix_user_id", (F.lit(NEW_SSO_ID_BASE) + F.col("devonix_user_id")).alias("id"),
                                    "ts", "fn", "ln", F.col("em").alias("new_email"), F.col("ph").alias("new_phone"),
                                    F.lit("inserted").alias("outcome"))))
    applied = cand.where(F.col("outcome") != "rejected")
    # UNIQUE(email): the e-mail a changed row ends with must not be held by any other row.
    others = (users.select("id", "email").join(applied.select("id"), "id", "left_anti")
              .select(F.col("email").alias("new_email"), F.lit(1).alias("n")))
    holders = (applied.select("new_email", F.lit(1).alias("n")).unionByName(others)
               .where(F.col("new_email").isNotNull()).groupBy("new_email").agg(F.sum("n").alias("holders")))
    # Two payloads landing on one user (one by id, one by e-mail) are a conflict as well.
    per_id = applied.groupBy("id").agg(F.count(F.lit(1)).alias("per_id"))
    clash = (F.coalesce(F.col("holders"), F.lit(1)) > 1) | (F.coalesce(F.col("per_id"), F.lit(1)) > 1)
    cand = (cand.join(holders, "new_email", "left").join(per_id, "id", "left")
                .withColumn("outcome", F.when((F.col("outcome") != "rejected") & clash, "conflict")
                                        .otherwise(F.col("outcome"))).drop("holders", "per_id"))
    ok = cand.where(F.col("outcome").isin("updated", "linked", "inserted"))

    upd = ok.where(F.col("outcome") != "inserted")
    cur = users.alias("u").join(upd.alias("c"), F.col("u.id") == F.col("c.id"), "left")
    touched = F.col("c.id").isNotNull()
    keep = [c for c in users.columns]

    def pick(col: str, new: Column) -> Column:
        return F.when(touched, new).otherwise(F.col(f"u.{col}")).alias(col)

    repl = {
        "first_name": F.col("c.fn"), "last_name": F.col("c.ln"),
        "email": F.col("c.new_email"), "phone": F.col("c.new_phone"), "last_login_at": F.col("c.ts"),
        "devonix_user_id": F.col("c.devonix_user_id"),
    }
    updated = cur.select(*[pick(c, repl[c]) if c in repl else F.col(f"u.{c}").alias(c) for c in keep])
    new_rows = ok.where(F.col("outcome") == "inserted").select(
        F.col("id"), F.lit("devonix").alias("login_source"), "devonix_user_id",
        F.col("fn").alias("first_name"), F.col("ln").alias("last_name"), F.col("new_email").alias("email"),
        F.col("new_phone").alias("phone"), F.col("ts").alias("last_login_at"), F.col("ts").alias("created_at"))
    nxt = updated.unionByName(_complete(new_rows, users), allowMissingColumns=False)
    report = cand.select("devonix_user_id", F.col("id").alias("user_id"), "outcome")
    return nxt, report


def _complete(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Add the missing user columns with the schema defaults (plan 'free', banned false)."""
    defaults = {"plan": F.lit("free"), "banned": F.lit(False)}
    cols = []
    for f in like.schema.fields:
        if f.name in rows.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name))
    return rows.select(*cols)


# ------------------------------------------------------------------ ID2

def merge_email_logins(users: DataFrame, logins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ID2: verified e-mail sign-ins: existing → last_login; banned → rejected; new → insert."""
    l = _latest(logins.where(F.col("email").isNotNull()), "email", ["ts"], ["ts"])
    u = users.select("id", "email", "banned")
    j = l.join(u, "email", "left")
    outcome = (F.when(F.col("id").isNull(), "inserted")
                .when(F.coalesce(F.col("banned"), F.lit(False)), "rejected").otherwise("login"))
    new_id = F.when(F.col("id").isNull(), F.abs(F.xxhash64(F.lit("email:"), F.col("email")))).otherwise(F.col("id"))
    report = j.select("email", new_id.alias("user_id"), outcome.alias("outcome"), "ts")
    logged = report.where(F.col("outcome") == "login").select(F.col("user_id").alias("id"), F.col("ts").alias("_ts"))
    upd = (users.join(logged, "id", "left")
                .withColumn("last_login_at", F.coalesce(F.col("_ts"), F.col("last_login_at"))).drop("_ts"))
    new_rows = report.where(F.col("outcome") == "inserted").select(
        F.col("user_id").alias("id"), F.lit("email").alias("login_source"), "email",
        F.col("ts").alias("last_login_at"), F.col("ts").alias("created_at"))
    return upd.unionByName(_complete(new_rows, users)), report.drop("ts")


# ------------------------------------------------------------------ ST1, ST2, SC6

def validate_actions(actions: DataFrame) -> DataFrame:
    """ST2: add ``reject`` (unknown_action / no_target / no_duration) and the parsed duration parts."""
    dur = {c: F.greatest(F.lit(0), js_int_or(F.col(c) if c in actions.columns else F.lit(None), 0))
           for c in ["months", "days", "hours", "minutes"]}
    x = actions.select("*", *[v.alias(f"_{k}") for k, v in dur.items()])
    zero = (F.col("_months") == 0) & (F.col("_days") == 0) & (F.col("_hours") == 0) & (F.col("_minutes") == 0)
    return x.withColumn("reject", F.when(F.col("target_id").isNull(), "no_target")
                                    .when(~F.coalesce(F.col("action").isin(ACTIONS), F.lit(False)), "unknown_action")
                                    .when((F.col("action") == "suspend") & zero, "no_duration"))


def apply_actions(users: DataFrame, actions: DataFrame, as_of: str = DEFAULT_AS_OF) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ST1: apply admin actions (one per row: seq, target_id, action, reason, months, days[, hours, minutes]).

    Returns (next users snapshot, audit rows, rejects).  Ban state and
    suspension are independent: the latest of {ban, unban} and the latest of
    {suspend, unsuspend} per user decide; any delete removes the user.  Every
    valid action writes an audit row, also for ids that match no user.
    """
    v = validate_actions(actions)
    rejects = v.where(F.col("reject").isNotNull()).select("seq", "target_id", "action", "reject")
    ok = v.where(F.col("reject").isNull())
    now = ts_lit(as_of)
    until = suspension_end(now, "_months", "_days", "_hours", "_minutes")
    reason = nullif_empty("reason")
    act = F.col("action")
    per = ok.groupBy(F.col("target_id").alias("id")).agg(
        F.max_by(F.struct((act == "ban").alias("b"), reason.alias("r")),
                 F.when(act.isin("ban", "unban"), F.col("seq"))).alias("ban"),
        F.max_by(F.struct((act == "suspend").alias("s"), reason.alias("r"), until.alias("u")),
                 F.when(act.isin("suspend", "unsuspend"), F.col("seq"))).alias("sus"),
        F.max(F.when(act.isin("ban", "unban"), F.col("seq"))).alias("ban_seq"),
        F.max(F.when(act.isin("suspend", "unsuspend"), F.col("seq"))).alias("sus_seq"),
        F.count_if(act == "delete").alias("deletes"))
    x = users.join(per, "id", "left")
    has_ban = F.col("ban_seq").isNotNull()
    has_sus = F.col("sus_seq").isNotNull()
    nxt = (x.where(F.coalesce(F.col("deletes"), F.lit(0)) == 0)
            .withColumn("banned", F.when(has_ban, F.col("ban.b")).otherwise(F.col("banned")))
            .withColumn("ban_reason", F.when(has_ban, F.when(F.col("ban.b"), F.col("ban.r"))).otherwise(F.col("ban_reason")))
            .withColumn("banned_at", F.when(has_ban, F.when(F.col("ban.b"), now)).otherwise(F.col("banned_at")))
            .withColumn("suspended_until", F.when(has_sus, F.when(F.col("sus.s"), F.col("sus.u")))
                                             .otherwise(F.col("suspended_until")))
            .withColumn("suspend_reason", F.when(has_sus, F.when(F.col("sus.s"), F.col("sus.r")))
                                            .otherwise(F.col("suspend_reason")))
            .select(*users.columns))
    audit = ok.select("seq", F.concat(act, F.lit("_user")).alias("action"),
                      F.col("target_id").cast("bigint").alias("target_user_id"))
    return nxt, audit, rejects


# ------------------------------------------------------------------ ST3

def upsert_settings(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """ST3: insert or overwrite by key; the latest change (by seq) per key wins."""
    latest = _latest(changes, "key", ["seq"], ["value"])
    kept = settings.join(latest.select("key"), "key", "left_anti")
    return kept.unionByName(latest.select("key", "value"))


def maintenance_on(settings: DataFrame) -> DataFrame:
    """One row: whether maintenance_mode is exactly 'true'."""
    return settings.agg(F.coalesce(F.max(F.when(F.col("key") == "maintenance_mode", F.col("value") == "true")),
                                   F.lit(False)).alias("maintenance"))


# ------------------------------------------------------------------ ST4

def cascade_delete(users: DataFrame, sessions: DataFrame, msgs: DataFrame, tokens: DataFrame,
                   ids: DataFrame) -> dict[str, DataFrame]:
    """ST4: delete users and cascade: sessions, messages and tokens of those users go;
    messages of removed sessions go; tokens of removed messages stay with message_id NULL.
    Audit rows are untouched (no foreign key).  All steps are anti/semi joins on keys.
    """
    gone = ids.select(F.col("id").cast("bigint").alias("id")).distinct()
    u = users.join(gone, "id", "left_anti")
    s = sessions.join(gone.withColumnRenamed("id", "user_id"), "user_id", "left_anti")
    m = (msgs.join(gone.withColumnRenamed("id", "user_id"), "user_id", "left_anti")
             .join(s.select(F.col("id").alias("session_id")), "session_id", "left_semi"))
    t = tokens.join(gone.withColumnRenamed("id", "user_id"), "user_id", "left_anti")
    alive = m.select(F.col("id").alias("message_id"), F.lit(True).alias("_alive"))
    t = (t.join(alive, "message_id", "left")
          .withColumn("message_id", F.when(F.col("_alive"), F.col("message_id")))
          .drop("_alive").select(*tokens.columns))
    return {"users": u, "dream_sessions": s, "dream_messages": m, "token_usage": t}


# ------------------------------------------------------------------ FB1, FB2

def latest_feedback(msgs: DataFrame, events: DataFrame) -> DataFrame:
    """FB1: apply feedback events (up / down / NULL clears; other values invalid).

    Only events on an existing AI message owned by the event's user count
    (JN4).  The latest valid event by (ts, id) sets the value.
    """
    valid = events.where(F.col("feedback").isNull() | F.col("feedback").isin("up", "down"))
    own = msgs.where(F.col("role") == "ai").select(F.col("id").alias("message_id"), "user_id")
    ok = valid.join(own, ["message_id", "user_id"], "left_semi")
    last = (ok.groupBy("message_id")
              .agg(F.max_by(F.struct("feedback"), F.struct("ts", "id")).alias("_l"))
              .select(F.col("message_id").alias("id"), F.col("_l.feedback").alias("_fb"), F.lit(True).alias("_t")))
    return (msgs.join(last, "id", "left")
                .withColumn("feedback", F.when(F.col("_t"), F.col("_fb")).otherwise(F.col("feedback")))
                .drop("_fb", "_t"))


def toggle_feedback(clicks: DataFrame, key: str = "message_id") -> DataFrame:
    """FB2: final state from button clicks (same button clears, other button switches).

    Within a run of equal clicks the state alternates value / NULL, and a
    different click always sets its value, so the final state is the last
    click if the trailing run of that click has odd length, else NULL.
    Computed with three aggregations by key (partial aggregation, no window).
    """
    order = F.struct("ts", "id")
    last = clicks.groupBy(key).agg(F.max_by("click", order).alias("last"))
    j = clicks.join(last, key)
    bound = j.groupBy(key).agg(F.max(F.when(F.col("click") != F.col("last"), order)).alias("bound"))
    run = (j.join(bound, key)
            .where(F.col("bound").isNull() | (order > F.col("bound")))
            .groupBy(key).agg(F.first("last").alias("last"), F.count(F.lit(1)).alias("run")))
    return run.select(key, F.when(F.col("run") % 2 == 1, F.col("last")).alias("feedback"))


# ------------------------------------------------------------------ EX1

def _total_order(df: DataFrame, key: str) -> list[Column]:
    """``key`` (NULL first), then all other columns: equal places hold equal rows only."""
    rest = [f for f in df.schema if f.name != key]
    return [F.col(key)] + [F.col(f.name) if isinstance(f.dataType, T.AtomicType) else F.to_json(F.struct(f.name))
                           for f in rest]


def _running_totals(ex: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Add, for each named count, its sum over all rows before this one in order of ``exchange_id``.

    A two-level prefix sum: rows are range-partitioned and sorted, each partition's sums (one small row each)
    give the totals that it starts from, and a partition then adds up its own rows as they stream by.  No task
    orders more than a partition, whatever the ids: they may be sparse, repeated (ordered by the other
    columns) or NULL (first).  The sorted rows are checkpointed, so that both passes see the same partitions.
    """
    from chatlake.session import checkpoint_dir
    checkpoint_dir(ex.sparkSession)
    names = list(counts)
    order = _total_order(ex, "exchange_id")
    x = (ex.repartitionByRange(*order).sortWithinPartitions(*order)
         .select("*", *[n.cast("bigint").alias(f"_n_{c}") for c, n in counts.items()]).checkpoint(eager=True)
         .withColumn("_part", F.spark_partition_id().cast("bigint")))
    carried, total = {}, np.zeros(len(names), dtype=np.int64)
    for r in sorted(x.groupBy("_part").agg(*[F.sum(f"_n_{c}").alias(c) for c in names]).collect(), key=lambda r: r["_part"]):
        carried[r["_part"]] = total
        total = total + np.array([r[c] for c in names], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not len(batch):
                continue
            before = carried[batch["_part"][0].as_py()] if before is None else before
            n = np.stack([batch[f"_n_{c}"].to_numpy() for c in names], axis=1)
            sums = before + np.cumsum(n, axis=0)
            before = sums[-1]
            keep = [c for c in batch.schema.names if c != "_part" and not c.startswith("_n_")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array(s) for s in (sums - n).T)],
                                             names=[*keep, *names])

    schema = T.StructType([*ex.schema.fields, *[T.StructField(c, T.LongType()) for c in names]])
    return x.mapInArrow(run, schema)


def log_exchanges(ex: DataFrame, default_category: str, new_title: str,
                  existing: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """EX1: persist chat exchanges as rows of sessions, messages and token usage.

    ``ex``: exchange_id, user_id, session_id (NULL → new session), category,
    entity, ts, usage array<struct<model, prompt_tokens, completion_tokens,
    total_tokens>>.  New ids go on from the largest id of the ``existing``
    tables (0 if not given), without gaps, in order of exchange_id (NULL first), so no two
    rows collide whatever the number of usage rows; reruns give the same ids.
    Message contents are stored empty, as the application does.
    """
    def last(table: str) -> Column:
        if existing is None or table not in existing:
            return F.lit(0).cast("bigint")
        return existing[table].agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("id")).scalar()

    usages = F.when(F.col("usage").isNull(), F.lit(0)).otherwise(F.size("usage"))
    ex = _running_totals(ex, {"_ahead": F.lit(1), "_sessions": F.col("session_id").isNull().cast("int"), "_usages": usages})
    ex = (ex.withColumn("_s", last("dream_sessions") + F.col("_sessions") + 1)
            .withColumn("_m", last("dream_messages") + F.col("_ahead") * 2 + 1)
            .withColumn("_u", last("token_usage") + F.col("_usages") + 1))
    new = ex.where(F.col("session_id").isNull())
    cat = F.col("category")
    sessions = new.select(F.col("_s").alias("id"), "user_id",
                          F.when(cat.isNull() | (cat == default_category), F.lit(new_title)).otherwise(cat).alias("title"),
                          F.col("ts").alias("created_at"))
    sid = F.coalesce(F.col("session_id"), F.col("_s"))
    user_row = F.struct(F.col("_m").alias("id"), F.lit("user").alias("role"),
                        cat.alias("category"), F.col("entity").alias("entity"))
    ai_row = F.struct((F.col("_m") + 1).alias("id"), F.lit("ai").alias("role"),
                      F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("entity"))
    messages = (ex.select(sid.alias("session_id"), "user_id", "ts", F.explode(F.array(user_row, ai_row)).alias("m"))
                  .select("m.id", "session_id", "user_id", "m.role", F.lit("").alias("content"), "m.category",
                          "m.entity", F.lit(None).cast("string").alias("feedback"), F.col("ts").alias("created_at")))
    u = ex.select("_m", "_u", "user_id", "ts", F.posexplode("usage").alias("i", "x"))
    p = F.coalesce(F.when(F.col("x.prompt_tokens") != 0, F.col("x.prompt_tokens")), F.lit(0)).cast("bigint")
    c = F.coalesce(F.when(F.col("x.completion_tokens") != 0, F.col("x.completion_tokens")), F.lit(0)).cast("bigint")
    t = F.coalesce(F.when(F.col("x.total_tokens") != 0, F.col("x.total_tokens")), p + c).cast("bigint")
    tokens = u.select((F.col("_u") + F.col("i")).alias("id"), "user_id",
                      (F.col("_m") + 1).alias("message_id"), F.col("x.model").alias("model"),
                      p.alias("prompt_tokens"), c.alias("completion_tokens"), t.alias("total_tokens"),
                      F.col("ts").alias("created_at"))
    return {"dream_sessions": sessions, "dream_messages": messages, "token_usage": tokens}


# ------------------------------------------------------------------ PF10

def account_gate(requests: DataFrame, users: DataFrame, settings: DataFrame,
                 rate_limited: DataFrame | None = None) -> DataFrame:
    """PF10: label each request with the first gate it fails, else 'ok'.

    Order: no_account (no user id, or unknown user) → banned → suspended
    (``suspended_until > ts``) → maintenance → rate_limited → message checks
    (missing / too_short / too_long).  ``rate_limited`` (request_id, limited)
    comes from the RL2 chain run on the requests that passed the earlier
    gates.  ``settings`` is reduced to its one maintenance flag (a single
    boolean read on the driver), applied as a literal.
    """
    from chatlake.operators.text import validate_messages
    u = users.select(F.col("id").alias("user_id"), "banned", "suspended_until", F.lit(True).alias("_known"))
    flag = bool(maintenance_on(settings).first()["maintenance"])
    x = requests.join(u, "user_id", "left").withColumn("maintenance", F.lit(flag))
    if rate_limited is not None:
        x = x.join(rate_limited.select("request_id", "limited"), "request_id", "left")
    else:
        x = x.withColumn("limited", F.lit(False))
    x = validate_messages(x, "text")
    gate = (F.when(F.col("user_id").isNull() | F.col("_known").isNull(), "no_account")
             .when(F.coalesce(F.col("banned"), F.lit(False)), "banned")
             .when(F.coalesce(F.col("suspended_until") > F.col("ts"), F.lit(False)), "suspended")
             .when(F.col("maintenance"), "maintenance")
             .when(F.coalesce(F.col("limited"), F.lit(False)), "rate_limited")
             .when(F.col("reason").isNotNull(), F.col("reason"))
             .otherwise("ok"))
    return x.select(*requests.columns, gate.alias("gate"))
