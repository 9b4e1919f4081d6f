"""Analytics semantics: LIKE wildcards, paging arithmetic, CSV quoting, NULL order, relative windows."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from chatlake.operators import metrics as M
from chatlake.operators import page_directory, top_items
from chatlake.sources.sinks import CSV_HEADER, users_csv_lines

USERS = ("id long, login_source string, first_name string, last_name string, email string, plan string, "
         "banned boolean, created_at timestamp_ntz")


def _users(spark, rows):
    return spark.createDataFrame(rows, USERS)


def test_search_wildcards_and_blank(spark):
    u = _users(spark, [
        (1, "email", "Ann", "50% off", "a@x.io", "free", False, None),
        (2, "email", "Bob", "5000", "b@x.io", "free", False, None),
        (3, "email", "A_n", "Lee", "c@x.io", "free", False, None),
        (4, "email", None, None, "ANN@x.io", "free", None, None),
    ])
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(M.user_search(u, "  ")) == [1, 2, 3, 4]         # blank = no filter
    assert ids(M.user_search(u, "50%")) == [1, 2]               # '%' stays a wildcard
    assert ids(M.user_search(u, "a_n")) == [1, 3, 4]            # '_' matches one character, ILIKE ignores case
    assert ids(M.user_filter(u, "EMAIL", "false")) == [1, 2, 3]  # NULL banned matches only 'any'
    assert ids(M.user_filter(u, "all", "maybe")) == []           # unknown banned filter → no rows
    assert ids(M.user_filter(u, "devonix", "any")) == []


def test_page_and_limit_parsing():
    assert [M.clamp_page(p) for p in [None, 0, -1, "x", "3abc", " 2", "7"]] == [1, 1, 1, 1, 3, 2, 7]
    assert [M.clamp_limit(v) for v in [None, 0, -5, 101, "50", "x", 1]] == [25, 25, 1, 100, 50, 25, 1]


def test_paginate_null_first_and_total_pages(spark):
    t0 = dt.datetime(2024, 1, 1)
    u = _users(spark, [(i, "email", f"n{i}", "L", f"{i}@x.io", "free", False,
                        None if i == 7 else t0 + dt.timedelta(days=i)) for i in range(1, 12)])
    rows, meta = M.paginate(u, [F.col("created_at").desc_nulls_first(), F.col("id").desc()], 1, 5)
    assert [r["id"] for r in rows.collect()] == [7, 11, 10, 9, 8]     # Postgres DESC puts NULL first
    m = meta.first()
    assert (m["total"], m["total_pages"]) == (11, 3)
    rows, _ = M.paginate(u, [F.col("created_at").desc_nulls_first(), F.col("id").desc()], "3", 5)
    assert [r["id"] for r in rows.collect()] == [1]


def test_csv_quoting_and_nulls(spark):
    u = _users(spark, [
        (1, "email", 'Say "hi"', "a,b", "q@x.io", "free", True, dt.datetime(2024, 1, 2, 3, 4, 5, 678000)),
        (2, "devonix", None, "", None, None, None, None),
    ])
    lines = [r["line"] for r in users_csv_lines(u, "").orderBy("line_no").collect()]
    assert lines[0] == CSV_HEADER
    assert lines[1] == '2,,"",,devonix,,1970-01-01T00:00:00.000Z,'       # NULL created_at sorts first (DESC)
    assert lines[2] == '1,"Say ""hi""","a,b","q@x.io",email,free,2024-01-02T03:04:05.678Z,true'


def test_relative_windows_are_strict_and_unbounded_above(spark):
    as_of = "2024-01-31 00:00:00"
    t = dt.datetime(2024, 1, 31)
    tokens = spark.createDataFrame([
        (1, "m", 5, t - dt.timedelta(days=1)),                  # exactly 1 day before: not "today"
        (2, "openrouter:x", 7, t - dt.timedelta(hours=23)),
        (3, None, 11, t + dt.timedelta(days=3)),                # future rows count
        (4, "synthesis:y", None, t - dt.timedelta(days=40)),
    ], "user_id long, model string, total_tokens long, created_at timestamp_ntz")
    r = M.token_totals(tokens, as_of).first()
    assert (r["total_tokens"], r["tokens_today"], r["tokens_last_30_days"], r["total_requests"]) == (23, 18, 23, 4)
    groups = {x["model_group"]: (x["requests"], x["tokens"]) for x in M.model_breakdown(tokens).collect()}
    assert groups == {"Groq": (2, 16), "OpenRouter": (1, 7), "Synthesis": (1, 0)}


def test_top_categories_tie_break(spark):
    msgs = spark.createDataFrame([(i, "user", c) for i, c in enumerate(["b", "a", "b", "a", "c"])],
                                 "user_id long, role string, category string")
    got = [(r["category"], r["count"]) for r in M.top_categories(msgs, 2).collect()]
    assert got == [("a", 2), ("b", 2)]


def test_keyset_paging_equals_offset_paging(spark):
    t0 = dt.datetime(2024, 1, 1)
    u = _users(spark, [(i, "email", "n", "L", f"{i}@x.io", "free", False, t0 + dt.timedelta(days=i % 5))
                       for i in range(1, 58)])
    order = [("created_at", True), ("id", True)]
    seen, after = [], None
    while True:
        page = M.keyset_page(u, order, after, 10).collect()
        if not page:
            break
        seen += [r["id"] for r in page]
        after = (page[-1]["created_at"], page[-1]["id"])
    full = [r["id"] for r in u.orderBy(F.col("created_at").desc(), F.col("id").desc()).collect()]
    assert seen == full


def test_write_users_csv_file(spark):
    import glob
    import tempfile
    from chatlake.sources.sinks import write_users_csv
    u = _users(spark, [(i, "email", f"N{i}", "L", f"{i}@x.io", "free", False,
                        dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(1, 4)])
    out = tempfile.mkdtemp(prefix="chatlake-csv-") + "/export"
    write_users_csv(u, out)
    lines = open(glob.glob(f"{out}/part-*")[0]).read().splitlines()
    assert lines[0] == CSV_HEADER and [ln.split(",")[0] for ln in lines[1:]] == ["3", "2", "1"]


def test_page_directory_reads_the_ranges_of_a_page(spark):
    """Every page equals OFFSET paging, ties and NULLs included; a deep page reads one range."""
    t0 = dt.datetime(2024, 1, 1)
    u = _users(spark, [(i, "email", "n", "L", f"{i}@x.io", "free", False,
                        None if i % 11 == 0 else t0 + dt.timedelta(days=i % 17)) for i in range(1, 1001)])
    order = [F.col("created_at").desc_nulls_first(), F.col("id").desc()]
    pages = page_directory.build(u, order, ranges=10)
    want = [r["id"] for r in u.orderBy(*order).collect()]
    assert pages.total == 1000 and len(pages.numbers) > 5
    got = []
    for p in range(1, 12):
        rows, meta = pages.page(p, 100)
        got += [r["id"] for r in rows.collect()]
        assert meta == {"total": 1000, "page": p, "limit": 100, "total_pages": 10}
    assert got == want
    assert len(pages.ranges(990, 10)) == 1 and pages.ranges(1000, 10) == [] and pages.page("x", 7)[1]["page"] == 1
    rows, _ = pages.page(150, 6)
    assert re.search(r"PartitionFilters: \[[^\]]*_range", rows._jdf.queryExecution().executedPlan().toString())
    assert [r["id"] for r in rows.collect()] == want[894:900]


def test_page_directory_one_value_and_empty(spark):
    u = _users(spark, [(i, "email", "n", "L", None, "free", False, None) for i in range(50)])
    pages = page_directory.build(u, [F.col("created_at").desc_nulls_first()], ranges=4)   # all rows tie
    seen = [r["id"] for p in range(1, 6) for r in pages.page(p, 10)[0].collect()]
    assert sorted(seen) == list(range(50))
    none = page_directory.build(u.limit(0), [F.col("id")])
    assert none.page(1, 10)[0].count() == 0 and none.page(1, 10)[1]["total_pages"] == 1


def test_top_items_equal_the_full_count(spark, monkeypatch):
    """Skewed items are found among the candidates; like counts are counted in full; few items are all held."""
    rows = [(i % 7, f"h{j}") for j in range(6) for i in range(400 - 40 * j)] + [(i % 7, f"rare{i}") for i in range(2000)]
    rows += [(0, None)] * 50
    df = spark.createDataFrame(rows, "day int, item string")
    full = lambda part, k: [tuple(r) for r in part.where("item IS NOT NULL").groupBy("item").count()
                            .orderBy(F.col("count").desc(), "item").limit(k).collect()]
    for part, k, tracked in ((df, 4, 64), (df, 9, 64), (df.where("item LIKE 'rare%'"), 3, 64),
                             (df.where("item LIKE 'h%'"), 20, 1024), (df.limit(0), 3, 64)):
        sketches = top_items.day_sketches(part, "item", F.col("day"), tracked)
        got = [tuple(r) for r in top_items.top_items(part, "item", k, sketches, tracked).collect()]
        assert got == full(part, k)
    sketches = top_items.day_sketches(df, "item", F.col("day"), 256)
    found, others, total = top_items.candidates(sketches, 256)
    assert {"h0", "h1", "h2", "h3"} <= set(found) and total == len(rows) - 50
    assert max(n for x, n in full(df, 10_000) if x not in found) <= others
