"""Corpus pipeline: quality rules, line dedup, near-duplicates, mixing, BPE.

Each stage reads what its predecessor wrote.  All but the last return the
columns of ``documents``; rejected rows are gone, cut texts are cut, and the
mix repeats rows that it takes twice.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.bpe_codec import encode_and_decode
from chatlake.llm.line_dedup import drop_boilerplate
from chatlake.llm.minhash import keep_one_of_each
from chatlake.llm.mixing import mix_rows
from chatlake.llm.quality import judge
from chatlake.llm.shared import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands."""
    kept = judge(docs, public_tokenizers.path("piece_bpe_32k.model")).filter("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines; n_chars follows the text."""
    cut = drop_boilerplate(docs, "source", "text")
    new = {"text": F.col("text"),
           "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return cut.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, repeats as rows of their own."""
    return mix_rows(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the decoded text."""
    coded = encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"),
                              keep=["doc_id", "lang", "source"], with_ids=True)
    return coded.select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("mixing", mixing), ("bpe", bpe)]

#: The fertility bands, the MinHash stage and the token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
