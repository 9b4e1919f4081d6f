"""Mixing sources to target weights by systematic sampling, in DataFrame operations.

Targets: the sources, by code point with null last, weigh 5, 2, 1, repeating,
and share 1.5 times all words in that proportion; a source stops at twice its
own size, and what it leaves is shared by weight among the others until none is
above.  Sorted by (twice the size) / weight the capped sources come first, so
one running sum over the sources finds the level.

Sampling: every document of a source expects ``target / source_size`` copies.
Walking through the source in a fixed order, the running sum of expected copies
plus one random offset of the source emits a copy at each integer it crosses,
so a document gets the floor or the ceiling of its expectation (2 at most).
Documents are ordered by size class first, which spreads the copies evenly over
short and long ones and keeps the taken words near the target.

The running sum is a rank times a constant.  Ranks come in two steps, so that
no source is ordered in one task: each (source, size class, digest prefix) block
is counted, blocks are summed up within the source (a bounded table), and rows
are numbered inside their block only.

Defined results: a null text has size 0; a source without words has target 0
and takes nothing; null doc_ids sort first and repeated rows are numbered one
after the other, so each counts as a document; reruns agree, since every choice
comes from digests of ``doc_id`` and the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.shared import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Hexadecimal digits of the digest that divide a size class into blocks (16 ** 2).
BLOCK_DIGITS = 2
SEED = "mix"


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source") -> DataFrame:
    """``row`` (the document as it was), id, source, site (never null), digest, tie and size."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(
        row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("site"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("digest"),
        F.xxhash64(*[_hashable(f) for f in docs.schema]).alias("tie"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def _hashable(field: T.StructField) -> Column:
    """The column, or its JSON where it holds a map, whose entries have no order to hash."""
    return F.to_json(F.struct(F.col(f"`{field.name}`"))) if "map<" in field.dataType.simpleString() else F.col(f"`{field.name}`")


def source_targets(sized: DataFrame) -> DataFrame:
    """site, source_size and target (double) from rows of (site, source, size)."""
    totals = sized.groupBy("site", "source").agg(F.sum("size").alias("source_size"))
    name = F.col("source").asc_nulls_last()
    place = (F.row_number().over(Window.orderBy(name)) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), place + 1)
    order = Window.orderBy(F.col("cap") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = ((F.sum("source_size").over(whole) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    levels = (totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(CAP))
              .withColumn("level", level).withColumn("turn", F.row_number().over(order)))
    # The level of the first source, in that order, which stays within its cap holds for all after it.
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("turn", "level"))).over(whole)
    share = F.coalesce(first.getField("level") * F.col("weight"), F.col("cap"))
    return levels.select("site", "source_size", F.least(F.col("cap"), share).alias("target"))


def sample(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """``rows`` (site, digest, tie, size and more) with source_size, target, copies and taken.

    ``sized`` has the same rows in narrow form, for the counts.
    """
    klass = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 4)).otherwise(F.lit(-1))
    key = ["site", "class", "block"]
    keyed = lambda df: (df.withColumn("class", klass.cast("int"))
                        .withColumn("block", F.substring("digest", 1, BLOCK_DIGITS)))
    before = Window.partitionBy("site").orderBy("class", "block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), "site").cast("binary")), 1, 8), 16, 10).cast("double")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = source_targets(sized).withColumn("expected", expected) \
        .withColumn("offset", offset / F.lit(4294967296.0))
    blocks = (keyed(sized).groupBy(key).agg(F.count("*").alias("n"))
              .withColumn("skipped", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(targets, "site"))
    within = Window.partitionBy(key).orderBy("digest", "size", "tie")
    placed = keyed(rows).withColumn("place", F.row_number().over(within)).join(blocks, key)
    sum_at = lambda rank: F.floor(rank * F.col("expected") + F.col("offset"))
    rank = F.col("skipped") + F.col("place")
    return (placed.withColumn("copies", sum_at(rank) - sum_at(rank - 1))
            .withColumn("taken", F.col("copies") * F.col("size"))
            .drop("class", "block", "place", "skipped", "expected", "offset"))


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source") -> DataFrame:
    """id, source, size, source_size, target, copies and taken of every document."""
    narrow = sized_rows(docs, id_col, text_col, source_col).drop("row")
    sized = Scratch(docs.sparkSession, "mixing").save(narrow, "sized")
    return sample(sized, sized).drop("site", "digest", "tie")


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    rows = sized_rows(docs, id_col, text_col, source_col)
    sized = Scratch(docs.sparkSession, "mixing").save(rows.drop("row"), "sized")
    taken = sample(rows.select("row", "site", "digest", "tie", "size"), sized).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
