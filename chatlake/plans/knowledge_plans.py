"""Registered knowledge-base queries (KB1-KB6, TX6) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.functions.semantics import BLANK_LINE_SEP, JS_WS_CLASS, LINE_SEP
from chatlake.operators import knowledge as K
from chatlake.operators import text as X
from chatlake.plans.oracle_views import with_views
from chatlake.plans.registry import register
from chatlake.session import checkpoint_dir
from chatlake.sources import tables as T

_TRIM = f"regexp_replace(@X@, '^{JS_WS_CLASS}+|{JS_WS_CLASS}+$', '', 'g')"


def _trim(x: str) -> str:
    return _TRIM.replace("@X@", x)


def _wc(x: str) -> str:
    return f"len(regexp_split_to_array({x}, '{JS_WS_CLASS}+'))"


def _chunks_sql(src: str, key: str, text: str, sep: str, target: int = 350) -> str:
    """CTEs 'paras' and 'chunks' = greedy packing by a recursive walk over paragraphs."""
    new = f"(w.cur = 0 OR w.cur + p.wc > {target})"
    base = f"(CASE WHEN {new} THEN 0 ELSE w.cur END)"
    return f"""
, sp AS (SELECT {key} AS k0, regexp_split_to_array({text}, '{sep}') AS a FROM {src}),
parts AS (SELECT k0, generate_subscripts(a, 1) AS i, unnest(a) AS p FROM sp),
trimmed AS (SELECT k0, i, {_trim("p")} AS tp FROM parts),
paras AS (SELECT k0, row_number() OVER (PARTITION BY k0 ORDER BY i) AS k, tp AS p, {_wc("tp")} AS wc
          FROM trimmed WHERE tp <> ''),
walk AS (
  SELECT k0, k, 0 AS chunk, wc AS cur FROM paras WHERE k = 1
  UNION ALL
  SELECT p.k0, p.k, w.chunk + CASE WHEN {new} THEN 1 ELSE 0 END,
         {base} + p.wc
  FROM walk w JOIN paras p ON p.k0 = w.k0 AND p.k = w.k + 1),
chunks AS (
  SELECT w.k0, w.chunk AS chunk_idx, string_agg(p.p, chr(10) || chr(10) ORDER BY p.k) AS content,
         CAST(sum(p.wc) AS BIGINT) AS n_words
  FROM walk w JOIN paras p ON p.k0 = w.k0 AND p.k = w.k GROUP BY 1, 2)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


# ---------------------------------------------------------------- KB1

@register("KB1_chunk_text", _recursive(with_views([], _chunks_sql("documents", "doc_id", "text", BLANK_LINE_SEP) + """
SELECT k0 AS doc_id, chunk_idx, content, n_words FROM chunks""")))
def kb1(spark, d):
    docs = T.load(spark, d, "documents").select("doc_id", "text")
    return K.chunk_text(docs, "text", ["doc_id"]).withColumn("n_words", F.col("n_words").cast("bigint"))


@register("KB1_chunk_text_lines", _recursive(with_views([], _chunks_sql("documents", "doc_id", "text", LINE_SEP) + """
SELECT k0 AS doc_id, chunk_idx, content, n_words FROM chunks""")))
def kb1_lines(spark, d):
    docs = T.load(spark, d, "documents").select("doc_id", "text")
    return K.chunk_text(docs, "text", ["doc_id"], sep=LINE_SEP).withColumn("n_words", F.col("n_words").cast("bigint"))


# ---------------------------------------------------------------- KB2

def _ingest_texts(spark, d):
    """Documents as knowledge texts: tradition = language, source_ref = source."""
    return T.load(spark, d, "documents").select("doc_id", F.col("lang").alias("tradition"),
                                                F.col("source").alias("source_ref"), "text")


def _ingest(spark, d, dims: int = 64):
    texts = _ingest_texts(spark, d)

    def enc(chunks):
        model = K.fit_vectoriser(chunks, "content", dims)
        return K.vectorise(chunks, model)
    return K.ingest(texts, "doc_id", enc, sep=LINE_SEP)


@register("KB2_ingest_report", _recursive(with_views([], f"""
, v AS (SELECT doc_id, text, CASE WHEN lang IS NULL OR lang = '' THEN 'no_tradition'
          WHEN text IS NULL OR length({_trim("text")}) < 20 THEN 'too_short'
          WHEN length(text) > 200000 THEN 'too_long' END AS reason FROM documents),
ok AS (SELECT doc_id, {_trim("text")} AS text FROM v WHERE reason IS NULL)
{_chunks_sql("ok", "doc_id", "text", LINE_SEP)}
SELECT v.doc_id, v.reason, CAST(count(c.chunk_idx) AS BIGINT) AS total_chunks,
  CAST(count(c.chunk_idx) FILTER (WHERE regexp_matches(c.content, '[\\p{{L}}\\p{{M}}\\p{{N}}_]')) AS BIGINT) AS inserted,
  CAST(count(c.chunk_idx) FILTER (WHERE NOT regexp_matches(c.content, '[\\p{{L}}\\p{{M}}\\p{{N}}_]')) AS BIGINT) AS failed
FROM v LEFT JOIN chunks c ON c.k0 = v.doc_id GROUP BY v.doc_id, v.reason""")))
def kb2(spark, d):
    _, rejects, report = _ingest(spark, d)
    ok = report.select("doc_id", F.lit(None).cast("string").alias("reason"), "total_chunks", "inserted", "failed")
    bad = rejects.select("doc_id", "reason", F.lit(0).cast("bigint").alias("total_chunks"),
                         F.lit(0).cast("bigint").alias("inserted"), F.lit(0).cast("bigint").alias("failed"))
    return ok.unionByName(bad)


# ---------------------------------------------------------------- KB3

@register("KB3_vectorise", with_views(["knowledge_chunks"], """
SELECT id, 256 AS dims, true AS is_unit FROM knowledge_chunks"""))
def kb3(spark, d):
    kc = T.knowledge_chunks(spark, d).select("id", "content")
    v = K.vectorise(kc, K.fit_vectoriser(kc, "content", 256))
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return v.select("id", F.size("embedding").alias("dims"), (F.abs(norm - 1) < 1e-5).alias("is_unit"))


# ---------------------------------------------------------------- KB4, TX6

_KB4 = """
, v AS (SELECT id, tradition, content, CAST(embedding AS DOUBLE[]) AS e FROM knowledge_chunks
        WHERE embedding IS NOT NULL AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
pairs AS (SELECT q.id AS query_id, c.id, c.content,
                 round(1 - list_cosine_similarity(q.e, c.e), 9) AS d FROM v q, v c),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM pairs)"""


@register("KB4_semantic_topk", with_views(["knowledge_chunks"], _KB4 + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(d, 6) AS dist FROM top WHERE rank <= 5"""))
def kb4(spark, d):
    kc = T.knowledge_chunks(spark, d)
    top = K.semantic_topk(kc.select(F.col("id").alias("query_id"), "embedding"), kc, k=5)
    return top.select("query_id", "rank", "id", F.round("dist", 6).alias("dist"))


@register("TX6_knowledge_block", with_views(["knowledge_chunks"], _KB4 + """
SELECT query_id, chr(10) || '[' || string_agg('[সূত্র ' || CAST(rank AS VARCHAR) || ']: ' || content,
                                    chr(10) || chr(10) ORDER BY rank) || ']' AS block
FROM top WHERE rank <= 5 GROUP BY query_id"""))
def tx6(spark, d):
    kc = T.knowledge_chunks(spark, d)
    top = K.semantic_topk(kc.select(F.col("id").alias("query_id"), "embedding"), kc, k=5)
    return X.knowledge_block(top, "query_id")


# ---------------------------------------------------------------- KB5 (approximate: rows-only check)

def approx_inputs(spark, d):
    """Chunk texts and benchmark passages, both encoded by one KB3 model."""
    checkpoint_dir(spark)
    # The fit and the transform both read the texts: they are joined once.
    kc = T.knowledge_chunks(spark, d).select("id", "content").checkpoint(eager=True)
    model = K.fit_vectoriser(kc, "content", 256)
    chunks = K.vectorise(kc, model)
    qs = K.vectorise(T.load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"),
                                                          F.col("text").alias("content")), model)
    return chunks, qs


@register("KB5_approx_topk")
def kb5(spark, d):
    """Benchmark passages as queries against the chunk texts."""
    chunks, qs = approx_inputs(spark, d)
    return K.approx_topk(qs, chunks, k=5)


# ---------------------------------------------------------------- KB6

@register("KB6_drop_tradition", with_views(["knowledge_chunks"], """
SELECT id, tradition FROM knowledge_chunks WHERE tradition <> 't3'"""))
def kb6(spark, d):
    kept, _ = K.drop_tradition(T.knowledge_chunks(spark, d), "t3")
    return kept.select("id", "tradition")


@register("KB6_drop_tradition_count", with_views(["knowledge_chunks"], """
SELECT COUNT(*) AS deleted FROM knowledge_chunks WHERE tradition = 't3'"""))
def kb6_count(spark, d):
    _, deleted = K.drop_tradition(T.knowledge_chunks(spark, d), "t3")
    return deleted


# ---------------------------------------------------------------- SC5

@register("SC5_knowledge_append", with_views(["knowledge_chunks"], """
SELECT tradition, COUNT(*) AS chunk_count FROM knowledge_chunks GROUP BY tradition"""))
def sc5(spark, d):
    """Append the chunk table in two batches to a folder under the checkpoint dir, one of them twice; read it back."""
    import uuid

    from chatlake.session import checkpoint_dir
    from chatlake.sources.sinks import append_knowledge
    path = f"{checkpoint_dir(spark)}/knowledge-{uuid.uuid4().hex[:8]}"
    chunks = T.knowledge_chunks(spark, d)
    for batch in ("0", "1", "0"):
        append_knowledge(chunks.where(F.pmod("id", F.lit(2)) == int(batch)), path, batch)
    return spark.read.parquet(path).groupBy("tradition").agg(F.count(F.lit(1)).alias("chunk_count"))
