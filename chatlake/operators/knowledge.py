"""Knowledge base: chunk, validate, vectorise, store, retrieve.

KB1 chunking is pure built-in higher-order functions on each text row (split,
transform, aggregate, slice): no UDF, no shuffle, whole texts.

KB4 exact retrieval deals queries and chunks into a square of blocks, as many as
the tasks need and not more, so the vectors that move grow with the table.  Each
pair of blocks meets in one task: its queries are held and its chunks stream past
them, screened by single-precision products and compared exactly where a product
comes near a query's k-th best.  The final top-k is a ``row_number() <= k`` over
k rows per query and block.  No vector passes through the driver and no query x
chunk pair is ever materialised as a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.functions.semantics import BLANK_LINE_SEP, js_trim, js_word_count
from chatlake.operators import vector_index
from chatlake.session import checkpoint_dir
from chatlake.sources.lexicon import MAX_KNOWLEDGE_CHARS, MIN_KNOWLEDGE_CHARS

TARGET_WORDS = 350
# Vectors in a block of KB4, at least: smaller tables are dealt into fewer blocks.
BLOCK_ROWS = 2048
# Numbers in a query block of KB4, on average at most: a task holds it twice, in both precisions.
BLOCK_VALUES = 1 << 23
# Chunks and queries of one matrix product, and the share of its pairs above which all are compared exactly.
TILE_ROWS, SLAB_ROWS, DENSE = 1024, 256, 0.02
# Numbers of the pairs that await the exact comparison together.
PENDING_VALUES = 1 << 21
# Distances are compared after rounding to this many decimals, so engines that
# differ in the last bits still agree on ties (broken by id).
DIST_DECIMALS = 9


# ------------------------------------------------------------------ KB1

def _paragraphs(text: Column, sep: str) -> Column:
    return F.filter(F.transform(F.split(text, sep, -1), lambda p: js_trim(p)), lambda p: p != "")


def _chunk_starts(words: Column, target_words: int) -> Column:
    """1-based indexes of the paragraphs that open a chunk (greedy packing fold)."""
    init = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("cur"), F.lit(1).alias("i"))

    def step(acc, w):
        new = (acc["cur"] == 0) | (acc["cur"] + w > target_words)
        base = F.when(new, F.lit(0)).otherwise(acc["cur"])
        starts = F.when(new, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"])
        return F.struct(starts.alias("starts"), (base + w).alias("cur"), (acc["i"] + 1).alias("i"))

    return F.aggregate(words, init, step)["starts"]


def _chunks(paras: Column, starts: Column) -> Column:
    n = F.size(paras)

    def one(c):
        s = F.element_at(starts, c)
        e = F.coalesce(F.try_element_at(starts, c + 1), n + 1)
        return F.array_join(F.slice(paras, s, e - s), "\n\n")

    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(starts), F.lit(1))), one)


def chunk_text(df: DataFrame, text_col: str = "text", key_cols: list[str] | None = None,
               target_words: int = TARGET_WORDS, sep: str = BLANK_LINE_SEP) -> DataFrame:
    """KB1: one row per chunk: key columns, chunk_idx (0-based), content, n_words.

    Paragraphs = split on ``sep``, JS-trimmed, empties dropped; words = split
    on JS whitespace.  A paragraph starts a new chunk when the current chunk
    is non-empty and would pass ``target_words``.
    Each intermediate array is its own column: Spark does not share common
    subexpressions inside lambdas, and it will not collapse projections that
    would duplicate these expensive expressions, so every array is built once.
    The fold records only chunk start indexes: O(paragraphs + chunks^2).
    """
    keys = key_cols if key_cols is not None else [c for c in df.columns if c != text_col]
    x = (df.select(*keys, _paragraphs(F.col(text_col), sep).alias("_p"))
           .where(F.size("_p") > 0)
           .withColumn("_w", F.transform("_p", js_word_count))
           .withColumn("_s", _chunk_starts(F.col("_w"), target_words))
           .withColumn("_n", F.transform(F.sequence(F.lit(1), F.size("_s")), lambda c: F.aggregate(
               F.slice("_w", F.element_at("_s", c),
                       F.coalesce(F.try_element_at("_s", c + 1), F.size("_w") + 1) - F.element_at("_s", c)),
               F.lit(0), lambda a, b: a + b)))
           .withColumn("_c", _chunks(F.col("_p"), F.col("_s"))))
    return (x.select(*keys, F.posexplode(F.arrays_zip(F.col("_c").alias("content"), F.col("_n").alias("n_words")))
                     .alias("chunk_idx", "z"))
             .select(*keys, "chunk_idx", "z.content", "z.n_words"))


# ------------------------------------------------------------------ PF9 (knowledge), KB2

def validate_texts(df: DataFrame, text_col: str = "text", tradition_col: str = "tradition") -> DataFrame:
    """PF9 (knowledge): reason = no_tradition / too_short (trimmed < 20) / too_long (> 200,000) / NULL."""
    t = F.col(text_col)
    tr = F.col(tradition_col)
    return df.withColumn("reason", F.when(tr.isNull() | (tr == ""), "no_tradition")
                                    .when(t.isNull() | (F.length(js_trim(t)) < MIN_KNOWLEDGE_CHARS), "too_short")
                                    .when(F.length(t) > MAX_KNOWLEDGE_CHARS, "too_long"))


def ingest(texts: DataFrame, key: str = "doc_id", vectorise_fn=None, sep: str = BLANK_LINE_SEP,
           target_words: int = TARGET_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """KB2: validate → trim → chunk → vectorise → rows to append, rejects, per-text report.

    ``texts`` has (key, tradition, source_ref, text).  Returns (chunks,
    rejects, report); report = (key, total_chunks, inserted, failed,
    failed_indexes) from one aggregation over the chunk rows.  A chunk fails
    when its vector is NULL or all zeros (it cannot be ranked by cosine).
    """
    v = validate_texts(texts)
    rejects = v.where(F.col("reason").isNotNull()).select(key, "reason")
    ok = v.where(F.col("reason").isNull()).select(
        key, js_trim("tradition").alias("tradition"),
        F.when(F.col("source_ref") == "", F.lit(None).cast("string")).otherwise(F.col("source_ref")).alias("source_ref"),
        js_trim("text").alias("text"))
    chunks = chunk_text(ok, "text", [key, "tradition", "source_ref"], target_words, sep)
    if vectorise_fn is not None:
        # The encoder fit and the transform both read the chunks: write them once
        # (reliable checkpoint in the shared folder) instead of chunking twice.
        checkpoint_dir(chunks.sparkSession)
        chunks = chunks.checkpoint(eager=True)
        chunks = vectorise_fn(chunks)
    else:
        chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    good = F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    chunks = chunks.withColumn("stored", good)
    report = (chunks.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_if("stored").alias("inserted"),
        F.count_if(~F.col("stored")).alias("failed"),
        F.array_sort(F.collect_list(F.when(~F.col("stored"), F.col("chunk_idx")))).alias("failed_indexes")))
    return chunks.where("stored").drop("stored"), rejects, report


# ------------------------------------------------------------------ KB3

def fit_vectoriser(df: DataFrame, text_col: str = "content", dims: int = 1536, idf: bool = True):
    """KB3 (fit): Spark ML encoder (tokenise, hash to ``dims``, IDF, L2-normalise).

    The application calls a remote embedding model; here the encoder is a
    Spark ML pipeline.  Fitting is one distributed pass that aggregates
    document frequencies into a dims-sized vector; precomputed vectors can be
    used instead.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer

    stages = [RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[^\p{L}\p{M}\p{N}_]+", minTokenLength=1),
              HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dims)]
    last = "_tf"
    if idf:
        stages.append(IDF(inputCol="_tf", outputCol="_idf"))
        last = "_idf"
    stages.append(Normalizer(inputCol=last, outputCol="_vec", p=2.0))
    return Pipeline(stages=stages).fit(df)


def vectorise(df: DataFrame, model, out_col: str = "embedding") -> DataFrame:
    """KB3 (apply): add ``out_col`` array<float> from a fitted encoder (text column as fitted)."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    return (out.withColumn(out_col, vector_to_array("_vec", "float32"))
               .drop("_tok", "_tf", "_idf", "_vec"))


# ------------------------------------------------------------------ KB4

def _valid_vectors(df: DataFrame, vec: str) -> DataFrame:
    """Drop NULL / empty / all-zero vectors (they are not in a cosine index)."""
    return df.where(F.col(vec).isNotNull() & F.exists(vec, lambda x: x != 0))


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as unit vectors, and which of them are finite throughout."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    with np.errstate(invalid="ignore", over="ignore"):
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
    return m, np.isfinite(m).all(axis=1)


class _Nearest:
    """The k nearest chunks of a block of queries, kept while chunks stream past.

    Distances are whole numbers of the last decimal that counts.  A chunk whose
    single-precision product lies below a query's k-th best by more than the
    product's error cannot be among its k nearest; the others are compared in
    double precision.  Most queries have no such chunk in a tile, which their
    largest product shows; the pairs left over wait for one comparison of many.
    """

    def __init__(self, ids: pa.Array, vectors: pa.Array, k: int) -> None:
        m, finite = _unit(vectors)
        self.query_id, self.exact, self.k = ids.filter(pa.array(finite)), m[finite], k
        self.near = self.exact.astype(np.float32)
        self.error = (m.shape[1] + 8) * 2.0 ** -23 + 2 * 10.0 ** -DIST_DECIMALS
        self.dist = np.full((len(self.exact), k), np.iinfo(np.int64).max)
        self.id = np.full((len(self.exact), k), np.iinfo(np.int64).max)
        self.least = np.full(len(self.exact), -np.inf, dtype=np.float32)
        self.product = np.empty(SLAB_ROWS * TILE_ROWS, dtype=np.float32)
        self.pending = max(1, PENDING_VALUES // m.shape[1])

    def add(self, ids: pa.Array, vectors: pa.Array) -> None:
        m, finite = _unit(vectors)
        ids, m = ids.to_numpy(zero_copy_only=False)[finite], m[finite]
        for lo in range(0, len(ids), TILE_ROWS):
            order = lo + np.argsort(ids[lo:lo + TILE_ROWS], kind="stable")
            self._meet(ids[order], m[order])

    def _meet(self, ids: np.ndarray, tile: np.ndarray) -> None:
        n, single = len(ids), np.ascontiguousarray(tile.astype(np.float32).T)
        asked, met, waiting, k = [], [], 0, min(self.k, n)
        for at in range(0, len(self.exact), SLAB_ROWS):
            slab = slice(at, at + SLAB_ROWS)
            least = self.least[slab]
            product = self.product[:len(least) * n].reshape(len(least), n)
            np.matmul(self.near[slab], single, out=product)
            rows = np.flatnonzero(product.max(axis=1) >= least)
            if not rows.size:
                continue
            seen = product[rows]
            near = seen >= least[rows, None]
            if np.count_nonzero(near) > DENSE * product.size and n > k:
                # the tile's own k-th best product bounds its k nearest, by an error on either side
                kth = np.partition(seen, n - k, axis=1)[:, n - k] - np.float32(2 * self.error)
                near = seen >= np.maximum(least[rows], kth)[:, None]
            if np.count_nonzero(near) > DENSE * product.size:
                # ids ascend in a tile: a distance and a place in one number order like (distance, id)
                key = _whole(self.exact[slab] @ tile.T) * n + np.arange(n)
                best = np.partition(key, k - 1, axis=1)[:, :k].ravel()
                self._keep(np.repeat(at + np.arange(len(least)), k), best // n, ids[best % n])
                continue
            q, c = np.divmod(np.flatnonzero(near.ravel()), n)
            asked.append(at + rows[q])
            met.append(c)
            waiting += len(c)
            if waiting >= self.pending:
                self._compare(asked, met, ids, tile)
                asked, met, waiting = [], [], 0
        self._compare(asked, met, ids, tile)

    def _compare(self, asked: list[np.ndarray], met: list[np.ndarray], ids: np.ndarray, tile: np.ndarray) -> None:
        if asked:
            q, c = np.concatenate(asked), np.concatenate(met)
            self._keep(q, _whole(np.einsum("ij,ij->i", self.exact[q], tile[c])), ids[c])

    def _keep(self, q: np.ndarray, d: np.ndarray, i: np.ndarray) -> None:
        in_reach = d <= self.dist[q, -1]
        q, d, i = q[in_reach], d[in_reach], i[in_reach]
        if not q.size:
            return
        at, own = np.unique(q, return_inverse=True)
        k = self.k
        own = np.concatenate([own, np.repeat(np.arange(at.size), k)])
        d, i = np.concatenate([d, self.dist[at].ravel()]), np.concatenate([i, self.id[at].ravel()])
        # own and d in one number; ids are looked at only if two of a query's distances are equal
        key = (own << 32) + np.minimum(d, (1 << 32) - 1)
        order = np.argsort(key)
        ranked = key[order]
        if (ranked[1:] == ranked[:-1]).any():
            order = np.lexsort((i, key))
        first = order[np.searchsorted(own[order], np.arange(at.size))[:, None] + np.arange(k)]
        self.dist[at], self.id[at] = d[first], i[first]
        self.least[at] = 1 - self.dist[at, -1] / 10.0 ** DIST_DECIMALS - self.error

    def rows(self) -> pa.RecordBatch:
        q, j = np.nonzero(self.dist < np.iinfo(np.int64).max)
        return pa.RecordBatch.from_arrays(
            [self.query_id.take(pa.array(q)), pa.array(self.id[q, j]), pa.array(self.dist[q, j] / 10.0 ** DIST_DECIMALS)],
            names=["query_id", "id", "dist"])


def _whole(cosine: np.ndarray) -> np.ndarray:
    return np.rint((1.0 - cosine) * 10.0 ** DIST_DECIMALS).astype(np.int64)


def _topk_of_pairs(k: int):
    """Partial top-k of the pairs of blocks in a partition; a pair's queries come before its chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, asked, top = None, [], None
        for batch in batches:
            pairs, chunk = batch["pair"].to_numpy(), batch["chunk"].to_numpy()
            cuts = np.flatnonzero((np.diff(pairs) != 0) | (np.diff(chunk) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if pairs[lo] != pair:
                    if top is not None:
                        yield top.rows()
                    pair, asked, top = pairs[lo], [], None
                if not chunk[lo]:
                    asked.append(part)
                elif asked:
                    if top is None:
                        held = pa.Table.from_batches(asked).combine_chunks().to_batches()[0]
                        top, asked = _Nearest(held["id"], held["vector"], k), [part]
                    top.add(part["id"], part["vector"])
        if top is not None:
            yield top.rows()
    return run


def _pairs_of_blocks(q: DataFrame, c: DataFrame, block_rows: int) -> DataFrame:
    """(pair, chunk, id, vector): each query and chunk once for each block that it meets, a pair in one partition."""
    side = math.ceil(math.sqrt(4 * c.sparkSession.sparkContext.defaultParallelism))
    few = F.least(F.lit(side), F.ceil(F.count(F.lit(1)) / block_rows))
    held = F.ceil(F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0)) / BLOCK_VALUES)
    # Scalar subqueries: no job runs while the plan is built.
    n_q = q.agg(F.greatest(F.lit(1), few, held).cast("bigint").alias("n")).scalar()
    n_c = c.agg(F.greatest(F.lit(1), few).cast("bigint").alias("n")).scalar()

    def dealt(df: DataFrame, chunk: int) -> DataFrame:
        own, n = F.pmod(F.xxhash64("id"), F.col("nc" if chunk else "nq")), F.col("nq" if chunk else "nc")
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
        qb, cb = ("other", "own") if chunk else ("own", "other")
        return (df.withColumn("nq", n_q).withColumn("nc", n_c).withColumn("own", own).withColumn("other", other)
                .select((F.col(qb) * F.col("nc") + F.col(cb)).cast("int").alias("pair"), F.lit(chunk).alias("chunk"), "id", "vector"))

    return (dealt(q, 0).unionByName(dealt(c, 1)).repartitionById(side * side, F.pmod("pair", F.lit(side * side)))
            .sortWithinPartitions("pair", "chunk"))


def semantic_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, query_key: str = "query_id",
                  query_vec: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """KB4: the k nearest chunks (cosine distance, ties by id) for every query.

    Returns (query_id, rank, id, dist, tradition, content).  Chunk content is
    joined back only for the k winners per query.  Vectors that hold a NULL or a
    number that is not finite take no part.
    """
    q = _valid_vectors(queries.select(F.col(query_key).cast("long").alias("id"), F.col(query_vec).alias("vector")), "vector")
    c = _valid_vectors(chunks.select(F.col("id").cast("long").alias("id"), F.col("embedding").alias("vector")), "vector")
    met = _pairs_of_blocks(q, c, block_rows)
    partial = met.mapInArrow(_topk_of_pairs(k), "query_id long, id long, dist double")
    w = Window.partitionBy("query_id").orderBy("dist", "id")
    top = partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    meta = chunks.select("id", "tradition", "content")
    return top.join(meta, "id").select("query_id", "rank", "id", "dist", "tradition", "content")


# ------------------------------------------------------------------ KB5

def approx_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, query_key: str = "query_id",
                index: vector_index.VectorIndex | None = None, rerank: int | None = None,
                probe_share: float = vector_index.PROBE_SHARE) -> DataFrame:
    """KB5: approximate k-NN by inverted cells and residual codes, then exact re-rank.

    Stands in for the HNSW index: every chunk is indexed, recall is below 1 and
    is measured against KB4 in the tests.  ``index`` is one that
    ``vector_index.build`` wrote before (default: one is built).  Vectors are
    joined to the candidate ids only (ties by id).
    """
    if index is None:
        # The index's passes and the exact re-rank all read the vectors: they are made and written once.
        checkpoint_dir(chunks.sparkSession)
        chunks = chunks.select("id", "embedding").checkpoint(eager=True)
        index = vector_index.build(chunks)
    q = queries.select(F.col(query_key).cast("long").alias("query_id"), F.col("embedding").alias("qv"))
    if not index.rows:
        return q.limit(0).select("query_id", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank"))
    cand = vector_index.candidates(q, index, rerank, probe_share)
    dist = vector_index.cosine_distance("qv", "embedding", DIST_DECIMALS)
    w = Window.partitionBy("query_id").orderBy("dist", "id")
    return (cand.join(chunks.select("id", "embedding"), "id").join(q, "query_id")
                .select("query_id", "id", dist.alias("dist"))
                .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


# ------------------------------------------------------------------ KB6

def drop_tradition(chunks: DataFrame, tradition: str) -> tuple[DataFrame, DataFrame]:
    """KB6: chunks without ``tradition`` (exact match) and the deleted count.

    On a table partitioned by tradition this is a partition drop; as a
    DataFrame it is a filter that Spark pushes into the scan.
    """
    kept = chunks.where(~(F.col("tradition") == tradition) | F.col("tradition").isNull())
    deleted = chunks.where(F.col("tradition") == tradition).agg(F.count(F.lit(1)).alias("deleted"))
    return kept, deleted
