"""Inputs that the fixtures of the registered queries do not hold."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from chatlake.operators import limits as L
from chatlake.operators import metrics as M
from chatlake.operators import text as X
from chatlake.sources.lexicon import LATIN


def test_rate_limit_with_null_and_large_keys(spark):
    t = dt.datetime(2024, 1, 1)
    big = 2 ** 53 + 1
    rows = [(i, None if i < 6 else big if i < 9 else big - 1, t + dt.timedelta(milliseconds=i)) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz").coalesce(1)
    got = {r.id: (r.k, r.limited) for r in L.rate_limit(df, "k", "ts", 60_000, 2, tie="id").collect()}
    assert got == {i: (k, n >= 2) for i, k, n in
                   [(i, None, i) for i in range(6)] + [(i, big, i - 6) for i in range(6, 9)]
                   + [(i, big - 1, i - 9) for i in range(9, 12)]}


def test_keyword_join_equals_literal_for_repeated_and_null_keys(spark):
    words = [k for _, _, _, k in LATIN.keyword_rows()]
    rows = [(1, f"x {words[0]} y"), (1, f"x {words[-1]} y"), (None, f"x {words[-1]} y"), (None, "nothing"), (2, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    found = [sorted((str(tuple(r)) for r in X.classify(df, "text", LATIN, ["id"], method=m).collect()))
             for m in ("literal", "join")]
    assert found[0] == found[1] and len(found[0]) == 5


def test_keyset_pages_keep_nulls(spark):
    rows = [(1, None), (2, dt.datetime(2024, 1, 2)), (3, dt.datetime(2024, 1, 3)), (4, None)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp_ntz")
    for desc in (True, False):
        seen, after = [], None
        while True:
            page = M.keyset_page(df, [("created_at", desc), ("id", desc)], after, 1).collect()
            if not page:
                break
            seen.append(page[0].id)
            after = (page[0].created_at, page[0].id)
        assert seen == ([4, 1, 3, 2] if desc else [2, 3, 1, 4])


def test_patterns_and_page_numbers(spark):
    df = spark.createDataFrame([("a@b.co",), ("a@b.co\n",), (None,)], "e string")
    assert [r.ok for r in df.select(M.valid_email(F.col("e")).alias("ok")).collect()] == [True, False, False]
    assert (M.clamp_page("৫"), M.clamp_page("5x"), M.clamp_page(None)) == (1, 5, 1)
