"""Odd columns, languages and long texts of operators that took them badly before."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from chatlake.llm import minhash, mixing, quality, secret_scan
from test_operators import prose


def test_near_dedup_keeps_every_column(make_docs):
    docs = make_docs([(1, prose(1, 30), "s"), (2, prose(1, 30), "s"), (3, prose(2, 30), "s")])
    names = ["_turn", "_kept_id", "_kept_hash", "row", "id", "hash", "turn", "a.b"]
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(i))
    docs = docs.withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert [r["_turn"] for r in kept.collect()] == [0, 0]


def test_mixing_takes_map_columns(make_docs):
    docs = make_docs(["a b c", "d e f", None]).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("x.y", F.lit(1))
    assert mixing.mix_sizes(docs).count() == 3
    assert set(mixing.mix_rows(docs).columns) == set(docs.columns)


def test_null_language_is_its_own(make_docs):
    """The empty language's texts do not set the band of texts without one."""
    docs = make_docs([prose(i, 60) for i in range(3)])
    langs = F.when(F.col("doc_id") == 0, F.lit(None)).when(F.col("doc_id") == 1, F.lit("")).otherwise(F.lit("=")).cast("string")
    keys = docs.withColumn("lang", langs).select(F.struct("lang").alias("row")).select(quality._lang("lang").alias("k"))
    assert sorted(r["k"] for r in keys.collect()) == ["", "=", "=="]


@pytest.mark.parametrize("piece", [secret_scan.PIECE, 3])
def test_secret_spans_in_pieces(make_docs, piece, monkeypatch):
    monkeypatch.setattr(secret_scan, "PIECE", piece)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcf09 xyz=AKI") for _ in range(400)) + " " + "".join(rng.choice("0af") for _ in range(n)) + " token=abcdefg"
             for n in (10, 23, 24, 25, 90)]
    hexes = next(i for i, r in enumerate(secret_scan.RULES) if r.kind == "hex")
    for i, row in enumerate(sorted(secret_scan.scan(make_docs(texts)).collect(), key=lambda r: r.row.doc_id)):
        got = [(s.start, s.stop) for s in row.found if s.place == hexes]
        assert got == [m.span() for m in re.finditer("[0-9a-f]+", texts[i]) if len(m[0]) >= 24]


def test_secret_scan_of_long_texts(make_docs):
    """Five megabytes of prose with one run, and 60,000 secrets in one text."""
    long = prose(3, 1_000_000) + " " + "0123456789abcdef" * 2
    many = " ".join(f"{i:032x}" for i in range(60_000))
    began = time.time()
    rows = {r.row.doc_id: r.n for r in secret_scan.scan(make_docs([long, many])).select("row", F.size("found").alias("n")).collect()}
    assert rows[0] == 1 and rows[1] >= 60_000
    assert time.time() - began < 60
