"""AG11/AG12 from frequency sketches: mergeable by day, and exact.

A day's items are summed up in a sketch of at most TRACKED counters, however many
items it has.  Sketches of days merge, and the merged sketch names the candidates:
the items whose least possible count is above its error.  The few candidates are
counted exactly.  An item that is not a candidate has at most twice the error, so
where the k-th candidate has more than that, or the candidates have all rows, the answer
is the exact one; where the bound does not separate rank k (many items of like
counts), all items are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of a sketch.
TRACKED = 1024


def error_share(tracked: int) -> float:
    """Most that a sketch errs, as a share of the rows: 3.5 over its table's size, a power of two that is 3/4 full."""
    size = 1
    while size * 0.75 < tracked:
        size *= 2
    return 3.5 / size


def day_sketches(rows: DataFrame, item: str, day: Column, tracked: int = TRACKED) -> DataFrame:
    """(day, sketch, n): one small row for each day, to be stored and merged."""
    return (rows.where(F.col(item).isNotNull()).groupBy(day.alias("day"))
            .agg(F.expr(f"approx_top_k_accumulate(`{item}`, {tracked})").alias("sketch"), F.count(F.lit(1)).alias("n")))


def candidates(sketches: DataFrame, tracked: int = TRACKED) -> tuple[list, float, int]:
    """Items of the merged sketch (at most ``tracked``), the most rows that any other item has, and all rows."""
    rows = sketches.agg(F.sum("n")).first()[0]
    if not rows:      # without sketches there is nothing to combine
        return [], 0.0, 0
    top = sketches.agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {tracked})")).first()[0]
    return [x["item"] for x in top], 2 * error_share(tracked) * rows, rows


def top_items(rows: DataFrame, item: str, k: int, sketches: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """The ``k`` most frequent items (item, count) of ``rows``, ties by item; ``sketches`` cover the same rows."""
    def counts(part: DataFrame) -> DataFrame:
        return part.where(F.col(item).isNotNull()).groupBy(item).agg(F.count(F.lit(1)).alias("count"))

    def best(part: DataFrame) -> DataFrame:
        return part.orderBy(F.col("count").desc(), F.col(item).asc()).limit(k)

    found, others, total = candidates(sketches, tracked)
    if found:
        exact = counts(rows.where(F.col(item).isin(found)))     # at most ``tracked`` rows
        held = sorted((r["count"] for r in exact.collect()), reverse=True)
        if sum(held) == total or (len(held) >= k and held[k - 1] > others):
            return best(exact)
    return best(counts(rows))
