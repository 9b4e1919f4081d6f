"""Line dedup by site-relative frequency.

Within each host, the share of its pages that contain a line is the line's
boilerplate ratio; lines above ``max_ratio`` are dropped from the host's pages.
Only 64-bit line fingerprints are shuffled, and a line is counted once a page.

A host's list of boilerplate lines is bounded whatever the host's size: each
line on it is in more than ``max_ratio`` of the pages, so there are fewer than
(lines of an average page) / max_ratio of them.  The lists are written first;
their measured size then decides between a broadcast and a sort-merge join, in
which Spark splits a hot host.

Defined results: a null text stays null (no lines); lines without a word are
neither counted nor dropped; null hosts are one host; a page all of whose lines
would go stays whole (a copied page, not a template); repeated rows are pages
of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.shared import Scratch

#: A line is boilerplate in more than this share of its host's pages ...
MAX_RATIO = 0.1
#: ... and in at least so many of them.
MIN_PAGES = 5

HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): the fingerprints of each host's boilerplate lines."""
    rows = pages.select(host.alias("host"), text.alias("text"))
    worded = F.filter(_lines(F.col("text")), lambda x: x.rlike(HAS_WORD))
    once = F.array_distinct(F.transform(worded, lambda x: F.xxhash64(x)))
    counts = rows.select("host", F.explode(once).alias("line")).groupBy("host", "line").agg(F.count("*").alias("k"))
    totals = rows.groupBy(F.col("host").alias("site")).agg(F.count("*").alias("pages"))
    return (counts.filter(F.col("k") >= min_pages)
            .join(totals, F.col("host").eqNullSafe(F.col("site")))
            .filter(F.col("k") > F.lit(max_ratio) * F.col("pages"))
            .groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines")))


def drop_boilerplate(pages: DataFrame, host_col: str, text_col: str, max_ratio: float = MAX_RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """``row`` (the page as it was), ``text``, ``n_lines`` and ``n_dropped`` of every page."""
    spark = pages.sparkSession
    lists = Scratch(spark, "lines").save(
        boilerplate(pages, F.col(host_col), F.col(text_col), max_ratio, min_pages), "lists")
    lists = lists.select(F.col("host").alias("_site"), F.col("lines").alias("_lines"))
    rows = pages.select(F.struct("*").alias("row"))
    joined = rows.join(lists, F.col(f"row.{host_col}").eqNullSafe(F.col("_site")), "left")
    text = F.col(f"row.{text_col}")
    lines = _lines(text)
    left = F.filter(lines, lambda x: ~(x.rlike(HAS_WORD) & F.array_contains(F.col("_lines"), F.xxhash64(x))))
    return (joined.withColumn("_left", F.when(F.col("_lines").isNotNull(), left))
            .withColumn("_cut", F.col("_left").isNotNull() & F.exists("_left", lambda x: x.rlike(HAS_WORD)))
            .select("row",
                    F.when(F.col("_cut"), F.array_join("_left", "\n")).otherwise(text).alias("text"),
                    F.coalesce(F.size(lines).cast("long"), F.lit(0)).alias("n_lines"),
                    F.when(F.col("_cut"), (F.size(lines) - F.size("_left")).cast("long"))
                    .otherwise(F.lit(0).cast("long")).alias("n_dropped")))
