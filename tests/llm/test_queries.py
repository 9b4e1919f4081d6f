"""The registered queries of the training-data operators on sf0.001: oracle parity, stable schemas, plans."""

from __future__ import annotations

import pytest

from chatlake.llm.queries import ORACLE, QUERIES
from fixture_paths import SF001
from oracle_check import canon, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan
    if name in ("op4_secret_scan", "op9_mixing"):       # native: no Python in the plan
        assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
    rows = [tuple(r) for r in df.collect()]
    assert df.columns and rows
    if name in ORACLE:
        cur = con.execute(ORACLE[name])
        assert canon(df.columns, rows) == canon([c[0] for c in cur.description], cur.fetchall())


def test_documents_keep_one_row_each(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").count()
    for name in ("op11_alignment", "op12_ngram_join"):
        assert QUERIES[name](spark, SF001).count() == docs
