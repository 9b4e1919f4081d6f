"""Exact top-k search by the Fagin threshold algorithm, in blocks.

Vectors are dealt evenly into blocks, queries into groups, and each pair of a
block and a group is one task.  In it every dimension has its list of the
block's vectors sorted by component.  A query walks all lists at once from the
end that favours it (descending for a positive component, ascending for a
negative one), scores each vector it meets for the first time, and stops once
the bound, the score of a vector made of the components at the present depth,
is below its kth score: nothing unmet can score more, nor tie.  Depths double,
so a step is one numpy operation.  The blocks' best are ranked at the end.

Defined results: vectors that are null, or hold a null or non-finite component,
and rows with a null id, which no result could name, take no part; a query meets vectors of its own length only (an empty vector
scores 0 with empty ones); repeated rows are candidates each, and a query is
kept from its own row only; scores must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.shared import Scratch

SCALE = 256
EVERY = 50
K = 5
#: Vectors in a block and queries in a group.
BLOCK = 8192
FIRST_DEPTH = 32


def best_of_block(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray,
                  query_rows: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, scores) of each query's k best in the block, ties to smaller ids."""
    n, d = vectors.shape
    lists = np.argsort(vectors, axis=0, kind="stable").T
    values = np.take_along_axis(vectors.T, lists, axis=1)
    out = []
    for i, q in enumerate(queries):
        use = np.flatnonzero(q)
        up = q[use] < 0
        met = np.zeros(n, dtype=bool)
        if use.size == 0:  # all scores are 0
            met[:] = True
            place, score = np.flatnonzero(rows != query_rows[i]), None
            score = np.zeros(place.size, dtype=np.int64)
            order = np.lexsort((ids[place], -score))[:k]
            out.append((i, place[order], score[order]))
            continue
        place, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        depth = 0
        while depth < n:
            reach = min(n, max(FIRST_DEPTH, 2 * depth))
            new = np.zeros(n, dtype=bool)
            new[lists[use[up], depth:reach]] = True
            new[lists[use[~up], n - reach:n - depth]] = True
            new &= ~met
            met |= new
            found = np.flatnonzero(new)
            found = found[rows[found] != query_rows[i]]
            place = np.concatenate([place, found])
            score = np.concatenate([score, vectors[found] @ q])
            order = np.lexsort((ids[place], -score))[:k]
            place, score = place[order], score[order]
            depth = reach
            edge = np.where(up, values[use, depth - 1], values[use, n - depth])
            if place.size == k and int(edge @ q[use]) < score[-1]:
                break
        out.append((i, place, score))
    return out


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            v_id, v_row = left["vec_id"].to_numpy(), left["row"].to_numpy()
            q_id, q_row = right["vec_id"].to_numpy(), right["row"].to_numpy()
            v_len, q_len = (np.array([len(x) for x in t["vector"].to_pylist()]) for t in (left, right))
            for size in np.unique(q_len).tolist():
                a, b = np.flatnonzero(v_len == size), np.flatnonzero(q_len == size)
                if not a.size:
                    continue
                vectors, queries = (
                    np.array(t["vector"].take(pa.array(at)).to_pylist(), dtype=np.int64).reshape(at.size, size)
                    for t, at in ((left, a), (right, b)))
                for i, place, score in best_of_block(vectors, v_id[a], v_row[a], queries, q_row[b], k):
                    n = place.size
                    found.append((np.full(n, q_id[b[i]]), np.full(n, q_row[b[i]]), v_id[a[place]], score))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_row", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
          every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k best rows of the whole table."""
    x = F.col("x")
    scratch = Scratch(vectors.sparkSession, "topk")
    usable = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"))
              .filter(x.isNotNull() & F.col("vec_id").isNotNull())
              .filter(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
              .select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("vector"))
              .withColumn("row", F.monotonically_increasing_id()))
    usable = scratch.save(usable, "vectors")
    queries = usable.filter(F.col("vec_id") % every == 0)
    n_blocks = max(1, -(-usable.count() // block))
    n_groups = max(1, -(-queries.count() // block))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = usable.withColumn("block", deal(n_blocks)).withColumn("set", to_all(n_groups))
    right = queries.withColumn("set", deal(n_groups)).withColumn("block", to_all(n_blocks))
    best = left.groupBy("block", "set").cogroup(right.groupBy("block", "set")).applyInArrow(
        _search(k), "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
