"""KB5: an approximate cosine index of inverted cells with residual codes.

A coarse quantiser puts every vector in the cell of its nearest centroid, and
its residual is coded four dimensions at a time, half a byte each.  Quantiser
and codebooks are trained on a bounded sample (SAMPLE_ROWS rows in the order of
a hash of their ids), and every row of the table is indexed.  The number of
cells grows with the square root of the table up to MAX_CELLS.  The index is a
table partitioned by cell, so a search reads the probed cells' folders only; a
large cell is divided into slots, so that no task holds a hot cell.

A search ranks the rows of a query's nearest cells by their codes and compares
the best of them on their whole vectors.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.session import checkpoint_dir

SAMPLE_ROWS = 16_384
MAX_CELLS = 4096
#: Rows of a cell in one slot, on average.
SLOT_ROWS = 8192
#: Dimensions of a subspace, and its codewords (half a byte).
SUB, WORDS = 4, 16
#: Share of the cells that a query looks into, and rows compared in full, in square roots of the table.
PROBE_SHARE, RERANK_ROOTS = 0.6, 3.0
ROUNDS = 8


def unit(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of a list column as unit vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    if not len(column):
        return np.zeros((0, dims or 1), dtype=np.float32)
    m = flat.reshape(len(column), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from a random choice of rows; a centre that loses all its rows stays."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        order = np.argsort(own, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(own[order]) > 0))
        sums = np.add.reduceat(x[order], heads, axis=0)
        centres[own[order][heads]] = sums / np.diff(np.append(heads, len(x)))[:, None]
    return centres


@dataclass
class Quantiser:
    """Cell centres (cells x dims) and residual codebooks (subspaces x WORDS x SUB)."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    def _parts(self, x: np.ndarray) -> np.ndarray:
        """(rows, subspaces, SUB), padded with zeros."""
        pad = -self.dims % SUB
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SUB)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and codes of the residuals as bytes of two codewords each."""
        cell = nearest(x, self.centres)
        parts = self._parts(x - self.centres[cell])
        words = np.stack([nearest(parts[:, s], self.books[s]) for s in range(parts.shape[1])], axis=1).astype(np.uint8)
        words = np.pad(words, ((0, 0), (0, words.shape[1] % 2)))
        return cell, words[:, 0::2] << 4 | words[:, 1::2]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Residuals of codes."""
        words = np.stack([codes >> 4, codes & 15], axis=2).reshape(len(codes), -1)[:, :len(self.books)]
        return self.books[np.arange(len(self.books)), words].reshape(len(codes), -1)[:, :self.dims]

    @classmethod
    def train(cls, sample: np.ndarray, cells: int, seed: int) -> Quantiser:
        rng = np.random.default_rng(seed)
        out = cls(k_means(sample, cells, rng), np.zeros((0, WORDS, SUB)))
        parts = out._parts(sample - out.centres[nearest(sample, out.centres)])
        books = [k_means(parts[:, s], WORDS, rng) for s in range(parts.shape[1])]
        out.books = np.stack([np.concatenate([b, np.repeat(b[:1], WORDS - len(b), axis=0)]) for b in books])
        return out


def _usable(df: DataFrame, vec: str) -> DataFrame:
    """Without NULL, empty or all-zero vectors, which have no direction."""
    return df.where(F.col(vec).isNotNull() & F.exists(vec, lambda x: x != 0))


@dataclass
class VectorIndex:
    """Table ``path`` (cell, slot, id, code) with its quantiser; ``slots`` of each cell, by number."""

    path: str
    quantiser: Quantiser | None
    slots: dict[int, int]
    rows: int

    def read(self, spark) -> DataFrame:
        return spark.read.schema("cell int, slot int, id long, code binary").parquet(self.path)


def build(chunks: DataFrame, path: str | None = None, vec: str = "embedding", sample_rows: int = SAMPLE_ROWS,
          cells: int | None = None, seed: int = 7) -> VectorIndex:
    """Index every row of ``chunks`` (id, vector) that has a direction."""
    spark = chunks.sparkSession
    path = path or f"{checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    usable = _usable(chunks.select("id", F.col(vec).alias("v")), "v")
    rows = usable.count()
    if not rows:
        return VectorIndex(path, None, {}, 0)
    cells = min(rows, cells or min(MAX_CELLS, max(1, math.ceil(math.sqrt(rows)))))
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow()
    quantiser = Quantiser.train(unit(sample["v"]), cells, seed)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cell, codes = quantiser.encode(unit(batch["v"]))
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(cell, pa.int32()),
                                                  pa.array([c.tobytes() for c in codes], pa.binary())],
                                                 names=["id", "cell", "code"])

    coded = usable.mapInArrow(encode, "id long, cell int, code binary").checkpoint(eager=True)
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / SLOT_ROWS).cast("int").alias("slots"))
    slots = {r["cell"]: r["slots"] for r in sizes.collect()}  # a row for each cell: at most MAX_CELLS
    of_cell = spark.createDataFrame(list(slots.items()), "cell int, slots int")
    (coded.join(F.broadcast(of_cell), "cell")
     .select("cell", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int").alias("slot"), "id", "code")
     .repartition("cell", "slot").write.partitionBy("cell").parquet(path))
    return VectorIndex(path, quantiser, slots, rows)


def probes(queries: DataFrame, index: VectorIndex, probe_share: float = PROBE_SHARE) -> DataFrame:
    """(cell, slot, query_id, qv): the slots of each query's nearest cells."""
    quantiser, slots = index.quantiser, index.slots
    known = np.array(sorted(slots), dtype=np.int64)
    n = max(1, math.ceil(probe_share * known.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                best = known[np.argsort(-(unit(batch["qv"]) @ quantiser.centres[known].T), axis=1, kind="stable")[:, :n]]
                parts = [[(c, s) for c in row for s in range(slots[c])] for row in best.tolist()]
                at = np.repeat(np.arange(len(batch)), [len(p) for p in parts])
                cell, slot = zip(*(x for p in parts for x in p))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int32()), pa.array(slot, pa.int32()), *(batch[c].take(pa.array(at)) for c in ("query_id", "qv"))],
                    names=["cell", "slot", "query_id", "qv"])

    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("slot", T.IntegerType()),
                           *queries.select("query_id", "qv").schema.fields])
    return queries.mapInArrow(run, schema)


def candidates(queries: DataFrame, index: VectorIndex, rerank: int | None = None, probe_share: float = PROBE_SHARE) -> DataFrame:
    """(query_id, id) of the rows whose codes rank best in each query's nearest cells."""
    quantiser = index.quantiser
    rerank = rerank or max(1, math.ceil(RERANK_ROOTS * math.sqrt(index.rows)))

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asked.num_rows and held.num_rows:
            width = len(held["code"][0].as_py())
            codes = np.frombuffer(b"".join(held["code"].to_pylist()), dtype=np.uint8).reshape(-1, width)
            vectors = quantiser.decode(codes) + quantiser.centres[held["cell"][0].as_py()]
            q, ids, q_ids = unit(asked["qv"]), held["id"].to_numpy(), asked["query_id"].to_numpy()
            for lo in range(0, len(q), 256):
                near = q[lo:lo + 256] @ vectors.T
                for i, row in enumerate(near):
                    best = np.lexsort((ids, -row))[:rerank] if row.size > rerank else np.arange(row.size)
                    found.append((np.full(best.size, q_ids[lo + i]), ids[best], row[best].astype(np.float64)))
        q, i, s = (np.concatenate(x) for x in zip(*found))
        return pa.table([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s)], names=["query_id", "id", "near"])

    asked = probes(_usable(queries, "qv"), index, probe_share)
    held = index.read(queries.sparkSession)
    scored = (asked.groupBy("cell", "slot").cogroup(held.groupBy("cell", "slot"))
              .applyInArrow(score, "query_id long, id long, near double"))
    w = Window.partitionBy("query_id").orderBy(F.col("near").desc(), "id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= rerank).select("query_id", "id")


def cosine_distance(a: str, b: str, decimals: int) -> Column:
    """1 - cosine of two array columns, rounded."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.round(1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), decimals)
