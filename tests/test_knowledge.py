"""Knowledge base: chunking against an independent fold; exact and approximate top-k."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatlake.functions.semantics import JS_WS_CHARS
from chatlake.operators import knowledge as K
from chatlake.operators import text as X
from chatlake.operators import vector_index as V
from chatlake.plans import knowledge_plans as KP
from chatlake.sources import tables as T
from fixture_paths import SF001, SF01, SF1

_WS = "[" + re.escape(JS_WS_CHARS) + "]"


def py_chunks(text: str, target: int = 350) -> list[str]:
    """Stated behaviour: as many whole paragraphs as fit in ``target`` words, one at least."""
    paras = [p.strip(JS_WS_CHARS) for p in re.split(r"\n" + _WS + r"*\n", text)]
    left = [(p, len(re.split(_WS + "+", p))) for p in paras if p]
    out = []
    while left:
        fits = [k for k in range(1, len(left) + 1) if k == 1 or sum(w for _, w in left[:k]) <= target]
        out.append("\n\n".join(p for p, _ in left[:fits[-1]]))
        left = left[fits[-1]:]
    return out


def _words(n: int, tag: str) -> str:
    return " ".join(f"{tag}{i}" for i in range(n))


CASES = [
    "",
    "   \n\n  ",
    _words(350, "a"),
    _words(351, "a"),
    _words(200, "a") + "\n\n" + _words(150, "b"),
    _words(200, "a") + "\n\n" + _words(151, "b"),
    _words(600, "a") + "\n\n" + _words(10, "b"),
    _words(10, "a") + "\n   \n" + _words(10, "b") + "\n　\n\n" + _words(345, "c"),
    "x\n\n\n\ny",
    " lead and trail  \n\n next",
    _words(100, "a") + "\n\n" + _words(600, "b") + "\n\n" + _words(5, "c"),
]


def test_chunking_matches_independent_fold(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "id long, text string")
    got = {}
    for r in K.chunk_text(df, "text", ["id"]).collect():
        got.setdefault(r["id"], []).append((r["chunk_idx"], r["content"], r["n_words"]))
    for i, t in enumerate(CASES):
        rows = sorted(got.get(i, []))
        want = py_chunks(t)
        assert [c for _, c, _ in rows] == want, i
        assert [n for _, _, n in rows] == [len(re.split(_WS + "+", c)) for c in want]


def _source_texts(spark, d):
    """Fixture: one text per document source, documents joined by a blank line in doc order.

    Test-only: it concatenates a whole source into one row, which is fine for a
    small fixture and is why it is not part of the library.
    """
    docs = T.load(spark, d, "documents")
    g = docs.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("xs"))
    return g.select("source", F.array_join(F.transform("xs", lambda x: x["text"]), "\n\n").alias("text"))


def test_chunking_source_texts_blank_lines(spark):
    src = _source_texts(spark, SF001)
    got = {}
    for r in K.chunk_text(src, "text", ["source"]).collect():
        got.setdefault(r["source"], []).append((r["chunk_idx"], r["content"]))
    for r in src.collect():
        assert [c for _, c in sorted(got[r["source"]])] == py_chunks(r["text"])


def test_semantic_topk_matches_numpy(spark):
    kc = T.knowledge_chunks(spark, SF001)
    rows = kc.select("id", "embedding").collect()
    ids = np.array([r["id"] for r in rows])
    m = np.array([r["embedding"] for r in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    d = np.round(1 - m @ m.T, K.DIST_DECIMALS)
    top = K.semantic_topk(kc.select(F.col("id").alias("query_id"), "embedding"), kc, k=5,
                          block_rows=32)   # forces several blocks on both sides
    got = {}
    for r in top.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for qi, q in enumerate(ids):
        order = np.lexsort((ids, d[qi]))[:5]
        assert [i for _, i in sorted(got[q])] == list(ids[order])


def test_semantic_topk_copies_grow_with_the_table(spark):
    """Many blocks' worth of rows: each row goes to as many blocks as the tasks need, not to one for each block of rows."""
    side = math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))
    for n in (400, 800):
        v = spark.range(n).select("id", F.array(F.sin("id") + 2, F.cos("id")).alias("vector"))
        met = K._pairs_of_blocks(v, v, block_rows=10)
        assert met.count() == 2 * side * n and met.select("pair").distinct().count() == side * side


def test_semantic_topk_ties_and_odd_vectors(spark):
    """Many equal and nearly equal vectors; NULL and infinite numbers take no part."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 9))
    rows = [(i, base[i % 40].tolist()) for i in range(400)]
    rows += [(400 + i, (base[i] + 1e-7 * rng.normal(size=9)).tolist()) for i in range(40)]
    rows = [(int(j), v) for j, (_, v) in zip(rng.permutation(len(rows)), rows)]
    odd = [(1000, [None] + [1.0] * 8), (1001, [float("inf")] + [1.0] * 8), (1002, [0.0] * 9), (1003, None)]
    df = spark.createDataFrame(rows + odd, "id long, embedding array<double>")
    df = df.withColumn("tradition", F.lit("t")).withColumn("content", F.lit("c"))
    got = {}
    for r in K.semantic_topk(df.withColumnRenamed("id", "query_id"), df, k=7, block_rows=100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["dist"]))
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    d = np.round(1 - m @ m.T, K.DIST_DECIMALS)
    assert sorted(got) == sorted(ids.tolist())
    for at, q in enumerate(ids):
        order = np.lexsort((ids, d[at]))[:7]
        assert [(i, round(x, 9)) for _, i, x in sorted(got[q])] == [(ids[j], abs(d[at][j])) for j in order]


def test_queries_of_a_block_are_merged_together(monkeypatch):
    """A tile of chunks costs one merge for all queries of the block, not one for each slab of them."""
    rng, merges = np.random.default_rng(12), []
    unique = np.unique
    monkeypatch.setattr(K.np, "unique", lambda *a, **b: merges.append(1) or unique(*a, **b))
    base = rng.normal(size=(9000, 6)).astype(np.float32)
    base[8000:8100], base[8100:8200] = base[:100], base[8000] + 1e-7 * rng.normal(size=(100, 6))
    ids, queries = rng.permutation(9000), base[np.r_[0:4000, 8000:8200]]

    def rows(x):
        return pa.array(x.tolist(), pa.list_(pa.float32()))
    top = K._Nearest(pa.array(np.arange(len(queries))), rows(queries), 4)
    for lo in range(0, 9000, 3000):
        top.add(pa.array(ids[lo:lo + 3000]), rows(base[lo:lo + 3000]))
    assert len(merges) <= 3 * 6
    q, c = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (queries.astype(np.float64), base.astype(np.float64)))
    d = np.rint((1 - q @ c.T) * 1e9).astype(np.int64)
    got = top.rows().to_pydict()
    for at in [*range(0, 4000, 37), *range(4000, 4200)]:
        order = np.lexsort((ids, d[at]))[:4]
        assert got["query_id"][4 * at:4 * at + 4] == [at] * 4 and got["id"][4 * at:4 * at + 4] == ids[order].tolist()


def test_knowledge_block_of_many_blocks(spark):
    """TX6 over the same search: a block for each query, its nearest chunk (itself) first."""
    df = spark.range(300).select("id", F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("embedding"),
                                 F.lit("t").alias("tradition"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("content"))
    top = K.semantic_topk(df.select(F.col("id").alias("query_id"), "embedding"), df, k=3, block_rows=20)
    rows = X.knowledge_block(top).collect()
    assert len(rows) == 300
    assert all(r["block"].startswith(f"\n[[{X.SOURCE_LABEL} 1]: c{r['query_id']}\n\n") for r in rows)


def test_approx_topk_makes_texts_and_vectors_once(spark):
    """The texts are joined once, and no pass over the vectors encodes the texts again."""
    chunks, q = KP.approx_inputs(spark, SF001)
    assert "Join" not in chunks._jdf.queryExecution().toString()
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def counted(v):
        made.add(1)
        return v
    counted = counted.asNondeterministic()
    vectors = chunks.select("id", "embedding").checkpoint()
    top = K.approx_topk(q, vectors.withColumn("embedding", counted("embedding")), k=5)
    assert top.count() > 0 and made.value == vectors.count()


def test_semantic_topk_without_vectors(spark):
    kc = T.knowledge_chunks(spark, SF001)
    q = kc.select(F.col("id").alias("query_id"), "embedding")
    assert K.semantic_topk(q, kc.limit(0)).count() == 0
    assert K.semantic_topk(q.limit(0), kc).count() == 0
    zero = kc.limit(3).withColumn("embedding", F.transform("embedding", lambda x: x * 0))
    assert K.semantic_topk(q, zero).count() == 0
    assert K.approx_topk(q, zero).count() == 0


@pytest.mark.parametrize("folder", [SF01, SF1])
def test_approx_topk_recall_and_pruning(spark, folder):
    """The registered query's own vectors: recall against the exact search, and the share of pairs compared in full."""
    chunks, q = KP.approx_inputs(spark, folder)
    chunks, q = chunks.checkpoint(), q.checkpoint()
    index = V.build(chunks)
    approx = K.approx_topk(q, chunks, k=5, index=index).select("query_id", "id")
    exact = K.semantic_topk(q.withColumnRenamed("content", "_c"), chunks.withColumn("tradition", F.lit("")), k=5) \
        .select("query_id", "id")
    recall = approx.join(exact, ["query_id", "id"]).count() / exact.count()
    asked = q.select("query_id", F.col("embedding").alias("qv"))
    share = V.candidates(asked, index).count() / (q.count() * index.rows)
    assert recall >= 0.9, recall
    assert share <= 0.15, share
    assert approx.groupBy("query_id").count().where("count > 5").count() == 0


def test_index_grows_and_holds_every_row(spark):
    rng = np.random.default_rng(3)
    for n, want in ((9, 3), (400, 20)):
        rows = [(i, rng.normal(size=6).tolist()) for i in range(n)] + [(10 ** 6, [0.0] * 6), (10 ** 6 + 1, None)]
        df = spark.createDataFrame(rows, "id long, embedding array<float>")
        index = V.build(df)
        assert index.quantiser.centres.shape == (want, 6) and index.rows == n
        assert sorted(r["id"] for r in index.read(spark).collect()) == list(range(n))
        got = K.approx_topk(df.where("id % 50 = 0").withColumnRenamed("id", "query_id"), df, k=1, index=index).collect()
        assert all(r["query_id"] == r["id"] and r["dist"] == 0 for r in got) and len(got) == -(-n // 50)


def test_hot_cell_is_divided(spark, monkeypatch):
    monkeypatch.setattr(V, "SLOT_ROWS", 20)
    rows = [(i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(300)] + [(300 + i, [float(i), -1.0, 0.0, 1.0, 0.5]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    index = V.build(df)
    assert max(index.slots.values()) >= 15 and index.read(spark).count() == 330
    got = K.approx_topk(df.where("id = 7").withColumnRenamed("id", "query_id"), df, k=5, index=index).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [0, 1, 2, 3, 4]


def test_only_probed_cells_are_read(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(100)], "id long, embedding array<float>")
    index = V.build(df)
    q = df.limit(1).select(F.col("id").alias("query_id"), F.col("embedding").alias("qv"))
    assert V.probes(q, index, 0.2).select("cell").distinct().count() == 2
    assert "PartitionFilters: [isnotnull(cell" in index.read(spark).where("cell = 1")._jdf.queryExecution().toString()


def test_codes_come_near(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 10)).astype(np.float32)
    quantiser = V.Quantiser.train(x, 8, 1)
    cell, codes = quantiser.encode(x)
    back = quantiser.centres[cell] + quantiser.decode(codes)
    assert ((back - x) ** 2).sum() < 0.35 * ((quantiser.centres[cell] - x) ** 2).sum()


def test_ingest_report_and_rejects(spark):
    texts = spark.createDataFrame([
        (1, "t", "", _words(400, "a") + "\n\n" + _words(20, "b")),
        (2, "", "s", _words(30, "a")),
        (3, "t", None, "short"),
        (4, " t ", "s", "!!! ??? ... " * 5),
    ], "doc_id long, tradition string, source_ref string, text string")

    def enc(chunks):
        return K.vectorise(chunks, K.fit_vectoriser(chunks, "content", 32, idf=False))
    chunks, rejects, report = K.ingest(texts, "doc_id", enc)
    assert {(r["doc_id"], r["reason"]) for r in rejects.collect()} == {(2, "no_tradition"), (3, "too_short")}
    rep = {r["doc_id"]: (r["total_chunks"], r["inserted"], r["failed"], list(r["failed_indexes"]))
           for r in report.collect()}
    assert rep[1] == (2, 2, 0, [])
    assert rep[4] == (1, 0, 1, [0])          # no word characters → zero vector → not stored
    assert {r["tradition"] for r in chunks.collect()} == {"t"}
