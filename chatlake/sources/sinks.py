"""Sinks: CSV export (SC4), knowledge append (SC5), audit append (SC6).

Writers never collect to the driver: they return DataFrames and write with
``DataFrameWriter`` (parquet for tables, text for the CSV export).  New
snapshots go to a new path; callers swap paths atomically (parquet has no
MERGE), so a lost executor just reruns its write task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.operators.metrics import user_search
from chatlake.functions.semantics import pg_desc

# Fixed value: the export header line.
CSV_HEADER = "ID,First Name,Last Name,Email,Login Source,Plan,Registered At,Banned"
CSV_MAX_ROWS = 5000


def _quoted(c: str) -> Column:
    """NULL → '' ; else '"' + value with '"' doubled + '"'."""
    return F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))


def _raw(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def users_csv_lines(users: DataFrame, search: str | None = "") -> DataFrame:
    """SC4: export lines (line_no, line); line 0 is the header.

    Search filter only; newest first; at most 5,000 rows (the export cap is
    the feature).  ``orderBy().limit()`` is a per-partition top-k, so the
    global sort never sees more than 5,000 rows per partition.
    """
    top = user_search(users, search).orderBy(pg_desc("created_at"), F.col("id").desc()).limit(CSV_MAX_ROWS)
    iso = F.date_format(F.coalesce(F.col("created_at"), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")),
                        "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    line = F.concat_ws(",", _raw("id"), _quoted("first_name"), _quoted("last_name"), _quoted("email"),
                       _raw("login_source"), _raw("plan"), iso, _raw("banned"))
    w = Window.orderBy(pg_desc("created_at"), F.col("id").desc())
    body = top.select(F.row_number().over(w).cast("bigint").alias("line_no"), line.alias("line"))
    header = users.sparkSession.createDataFrame([(0, CSV_HEADER)], "line_no bigint, line string")
    return header.unionByName(body)


def write_users_csv(users: DataFrame, path: str, search: str | None = "") -> None:
    """Write the export as one text file (header first); bounded at 5,001 lines."""
    (users_csv_lines(users, search).coalesce(1).sortWithinPartitions("line_no")
     .select("line").write.mode("overwrite").text(path))


def append_knowledge(chunks: DataFrame, path: str, batch: str = "0") -> None:
    """SC5: append one batch of chunk rows, in folders of its own by tradition (KB6 then drops folders).

    A batch that is run again replaces itself, so nothing is stored twice.  Rejected chunks and their indexes
    are in the report of ``operators.knowledge.ingest``, whose stored chunks are this function's input.
    """
    _replace_batch(chunks, path, batch, ["tradition"])


def append_audit(audit: DataFrame, path: str, batch: str = "0") -> None:
    """SC6: append the audit rows of one batch of actions (``operators.state.apply_actions``), once."""
    _replace_batch(audit, path, batch, [])


def _replace_batch(rows: DataFrame, path: str, batch: str, by: list[str]) -> None:
    (rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch", *by).parquet(path))
