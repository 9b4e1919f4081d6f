"""Join helpers: size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Dictionaries and other "small" sides above this many rows are left to AQE
# (sort-merge or shuffled hash join) instead of being broadcast.
BROADCAST_MAX_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows.

    The check is a ``limit(max_rows + 1).count()`` job, so it reads at most
    ``max_rows + 1`` rows however large ``df`` is.  Beyond the bound the
    DataFrame is returned unhinted and AQE chooses the join at run time.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
