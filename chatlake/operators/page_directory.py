"""SL2 for deep pages: an order-statistics directory over a table in page order.

The table is written once in its page order, as ranges: range-partitioned and
sorted by the order's keys, every row with its place in its range.  The
directory is the exact number of rows of each range, so the offset of a page
names the one or two ranges that hold it, and a page reads those only, however
deep it lies.  NULLs stand where the order's expressions put them; rows that tie
in all of them keep one order, as their places are stored.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.operators.metrics import clamp_page
from chatlake.session import checkpoint_dir

_RANGE, _PLACE = "_range", "_place"


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_PLACE, T.LongType()), T.StructField(_RANGE, T.IntegerType())])


@dataclass
class PageDirectory:
    """Ranges below ``path``; ``ends[i]`` rows lie in the ranges up to the i-th of ``numbers``."""

    spark: SparkSession
    path: str
    schema: T.StructType
    numbers: list[int]
    ends: list[int]

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0

    def ranges(self, offset: int, limit: int) -> list[int]:
        """Numbers of the ranges that hold the rows offset, ..., offset + limit - 1."""
        last = min(offset + limit, self.total) - 1
        if last < offset:
            return []
        return self.numbers[bisect_right(self.ends, offset):bisect_right(self.ends, last) + 1]

    def page(self, page, limit: int) -> tuple[DataFrame, dict[str, int]]:
        """The rows of a page in order, and its meta figures."""
        number, limit = clamp_page(page), int(limit)
        offset = (number - 1) * limit
        wanted = self.ranges(offset, limit)
        rows = (self.spark.read.schema(_stored(self.schema)).parquet(self.path).where(F.col(_RANGE).isin(wanted)))
        before = dict(zip(self.numbers, [0, *self.ends]))
        keep = F.lit(False)
        for r in wanted:
            lo = offset - before[r]
            keep = keep | ((F.col(_RANGE) == r) & F.col(_PLACE).between(lo, lo + limit - 1))
        meta = {"total": self.total, "page": number, "limit": limit, "total_pages": max(1, -(-self.total // limit))}
        return rows.where(keep).orderBy(_RANGE, _PLACE).drop(_RANGE, _PLACE), meta


def build(df: DataFrame, order: list[Column], path: str | None = None, ranges: int | None = None) -> PageDirectory:
    """Write ``df`` in page order; ``order`` should end with a unique column."""
    spark = df.sparkSession
    path = path or f"{checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
     .withColumn(_PLACE, place).withColumn(_RANGE, F.spark_partition_id())
     .write.partitionBy(_RANGE).parquet(path))
    schema = T.StructType(list(df.schema.fields))
    held = spark.read.schema(_stored(schema)).parquet(path)
    sizes = sorted((r[_RANGE], r["n"]) for r in held.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("n")).collect())
    return PageDirectory(spark, path, schema, [r for r, _ in sizes], list(accumulate(k for _, k in sizes)))
