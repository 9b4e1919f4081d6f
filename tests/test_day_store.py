"""Stored days: refreshed figures equal full ones, and a refresh reads the changed days only."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chatlake.operators import day_store as D
from chatlake.operators import metrics as M

AS_OF = "2024-03-10 15:30:00"      # inside a day: every window begins inside one
T0 = dt.datetime(2023, 2, 20)


def _facts(spark, seed=1, n=300):
    rng = random.Random(seed)
    when = lambda: None if rng.random() < 0.03 else T0 + dt.timedelta(minutes=rng.randrange(0, 400 * 24 * 60))
    who = lambda: rng.choice([None, 1, 2, 40_000, 70_000, -5, 0, 5_000_000_000, *range(10)])
    users = [(i, rng.choice(["devonix", "email"]), rng.choice([True, False, None]), when()) for i in range(n)]
    msgs = [(i, who(), rng.choice(["user", "user", "ai"]), rng.choice([None, "a", "b", "c"]), rng.choice([None, "up", "down"]), when())
            for i in range(2 * n)]
    edge = dt.datetime(2024, 3, 9, 15, 30)   # exactly a day before: outside
    msgs += [(9001, 3, "user", "a", None, edge), (9002, 3, "user", "a", None, edge + dt.timedelta(microseconds=1))]
    tokens = [(i, who(), rng.choice([None, "openrouter:x", "synthesis:y", "m"]), rng.choice([None, 5, 7]), when()) for i in range(n)]
    return {"users": spark.createDataFrame(users, "id long, login_source string, banned boolean, created_at timestamp_ntz"),
            "messages": spark.createDataFrame(msgs, "id long, user_id long, role string, category string, feedback string, "
                                                    "created_at timestamp_ntz"),
            "tokens": spark.createDataFrame(tokens, "id long, user_id long, model string, total_tokens long, "
                                                    "created_at timestamp_ntz")}


def _rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def _check(store, facts):
    want = M.dashboard(facts["users"], facts["messages"], facts["tokens"], AS_OF)
    got = store.dashboard(facts, AS_OF)
    assert got.keys() == want.keys()
    assert _rows(M.long_table(got)) == _rows(M.long_table(want))
    assert _rows(store.user_token_summary(facts, AS_OF)) == _rows(M.user_token_summary(facts["tokens"], AS_OF))


@pytest.fixture()
def store(spark, tmp_path):
    return D.DayStore(spark, str(tmp_path / "days"))


def test_full_build_equals_the_dashboard(spark, store):
    facts = _facts(spark)
    store.refresh(facts)
    _check(store, facts)


def test_new_late_and_deleted_rows(spark, store):
    facts = _facts(spark)
    store.refresh(facts)
    # A new day, late rows of an old one and rows without a time ...
    late = {"messages": [(10_000 + i, 77 + i, "user", "new", None, t) for i, t in
                         enumerate([dt.datetime(2024, 3, 20), dt.datetime(2024, 3, 20, 5), dt.datetime(2023, 12, 5), None])]}
    more = {k: spark.createDataFrame(v, facts[k].schema) for k, v in late.items()}
    # ... and a user who goes, with all rows (the only one on some days).
    gone = facts["messages"].where("user_id = 1"), facts["tokens"].where("user_id = 1")
    now = dict(facts, messages=facts["messages"].unionByName(more["messages"]).where("user_id IS NULL OR user_id <> 1"),
               tokens=facts["tokens"].where("user_id IS NULL OR user_id <> 1"))
    days = D.changed_days(*more.values(), *gone)
    assert dt.date(2024, 3, 20) in days and None in days
    store.refresh(now, days)
    _check(store, now)


def test_a_day_that_loses_all_rows_disappears(spark, store):
    rows = [(1, 5, "user", "a", None, dt.datetime(2024, 3, 1)), (2, 5, "user", "a", None, dt.datetime(2024, 3, 2))]
    facts = _facts(spark, n=1)
    facts["messages"] = spark.createDataFrame(rows, facts["messages"].schema)
    store.refresh(facts)
    assert store.read("actives").count() == 2
    facts["messages"] = facts["messages"].where("id = 1")
    store.refresh(facts, [dt.date(2024, 3, 2)])
    assert [r["day"] for r in store.read("actives").collect()] == [dt.date(2024, 3, 1)]
    _check(store, facts)


def test_refresh_reads_the_changed_days_only(spark, store, tmp_path):
    facts = _facts(spark)
    stored = {}
    for name, df in facts.items():
        df.withColumn("d", F.to_date("created_at")).write.partitionBy("d").parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name)).drop("d")
    day = dt.date(2024, 3, 1)
    part = D.of_days(stored["messages"], [day])
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(created_at,2024-03-01" in plan
    assert {r["d"] for r in part.select(F.to_date("created_at").alias("d")).collect()} <= {day}
    store.refresh(stored)
    before = {r["f"]: r["m"] for r in _files(spark, store)}
    store.refresh(stored, [day])
    changed = {f for f in {r["f"] for r in _files(spark, store)} ^ before.keys()}
    assert changed and all("month=2024-03" in f for f in changed)


def _files(spark, store):
    return [r for name in D.TABLES for r in spark.read.parquet(f"{store.path}/{name}")
            .select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("m")).distinct().collect()]


def test_number_ids_keeps_known_numbers(spark):
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "user_id string")
    first = D.number_ids(frame("b", "a", "a", None, "ü"))
    one = {r["user_id"]: r["number"] for r in first.collect()}
    assert sorted(one.values()) == [1, 2, 3]
    two = {r["user_id"]: r["number"] for r in D.number_ids(frame("z", "a", "q"), first).collect()}
    assert {k: two[k] for k in one} == one and sorted(two.values()) == [1, 2, 3, 4, 5]
    assert D.number_ids(frame().limit(0)).count() == 0
