"""Physical-plan checks: no cartesian products, pruned scans, pushed filters, no row-wise UDFs."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from chatlake.plans import catalog
from fixture_paths import SF001

# Theta joins on purpose: the large-dictionary keyword match joins a
# size-checked broadcast dictionary on contains().
THETA_OK = {"JN6_keyword_match_join"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_cartesian_or_row_udf(spark, name):
    if name.startswith(("RL3", "SM")):
        pytest.skip("streaming queries return their sink table")
    plan = _plan(E.queries()[name](spark, SF001))
    assert "CartesianProduct" not in plan
    if name not in THETA_OK:
        assert "BroadcastNestedLoopJoin" not in plan, name
    assert "BatchEvalPython" not in plan          # no row-at-a-time Python UDF anywhere


def test_scan_prunes_columns_and_pushes_filters(spark):
    plan = _plan(E.queries()["AG5_daily_active_users"](spark, SF001))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan


def test_dashboard_reads_each_fact_once(spark):
    from chatlake.operators import metrics as M
    from chatlake.sources import tables as T
    df = M.dashboard_long(T.users(spark, SF001), T.dream_messages(spark, SF001), T.token_usage(spark, SF001))
    assert "Scan parquet" not in _plan(df)        # parts read only the materialised pre-aggregates


def test_keyword_join_broadcasts_dictionary(spark):
    plan = _plan(E.queries()["JN6_keyword_match_join"](spark, SF001))
    assert "BroadcastNestedLoopJoin" in plan and "BroadcastExchange" in plan
