"""First keyword of an ordered dictionary in each text, by one pass of a multi-pattern automaton.

The keywords' UTF-8 bytes form a trie whose states know their longest proper
suffix in the trie and the least rank of all keywords that end in them.  UTF-8
never finds a character's bytes inside another's, so matching bytes is matching
code points.  A batch of texts is cut into lanes of bounded length (each begins
a keyword's length early) that advance together, one byte of every lane in a
NumPy step; the least rank met is the answer.  The cost is one table look-up a
byte, whatever the number of keywords, and the text rows pass through untouched:
no join, no shuffle.

The automaton goes to every task, so its size is bounded: a dictionary of more
than MAX_KEYWORDS keywords is scanned in several passes, each of which carries
the least rank so far.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.session import checkpoint_dir

#: Keywords of one automaton.
MAX_KEYWORDS = 250_000
#: States with a full row of 256 transitions; deeper ones look theirs up.
DENSE = 16_384
#: Bytes of a lane, besides the keyword's length that it begins early, and of the texts scanned at once.
LANE, SLICE_BYTES = 1024, 4 << 20
#: Rank of a text without keywords.
NO_HIT = np.iinfo(np.int32).max


class Automaton:
    """States in the order of their depth, the root being 0."""

    def __init__(self, keywords: list[str], ranks: list[int] | None = None) -> None:
        """``ranks`` (default: the list's order): the least of the keywords found wins."""
        packed = [k.encode() for k in keywords]
        rank = np.arange(len(packed), dtype=np.int64) if ranks is None else np.array(ranks, dtype=np.int64)
        size = np.array([len(p) for p in packed], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(packed), dtype=np.uint8)
        self.longest = int(size.max(initial=0))

        at = np.zeros(len(packed), dtype=np.int64)      # each keyword's state so far
        parents, edges, ends, n = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [], 1
        depths = [0, 1]
        ends.append((at[size == 0], rank[size == 0]))
        for depth in range(self.longest):
            live = np.flatnonzero(size > depth)
            key, number = np.unique(at[live] << 8 | data[first[live] + depth], return_inverse=True)
            at[live] = n + number
            parents.append(key >> 8)
            edges.append(key & 255)
            n += key.size
            depths.append(n)
            done = size == depth + 1
            ends.append((at[done], rank[done]))
        parent, edge = np.concatenate(parents), np.concatenate(edges)
        best = np.full(n, NO_HIT, dtype=np.int64)
        for state, r in ends:
            np.minimum.at(best, state, r)
        self.n = n
        # Transitions in the trie, sorted by (state, byte): states are numbered in that order level by level.
        self.keys = parent[1:] << 8 | edge[1:]
        self.dense = np.zeros((0, 256), dtype=np.int32)
        self.fail = np.zeros(n, dtype=np.int64)
        best[0] = min(best[0], NO_HIT)
        for lo, hi in zip(depths[1:-1], depths[2:]):     # states lo:hi have one depth
            states = np.arange(lo, hi)
            if lo > 1:
                self.fail[states] = self._step(self.fail[parent[states]], edge[states])
            best[states] = np.minimum(best[states], best[self.fail[states]])
        self.best = np.minimum(best, best[0]).astype(np.int32)
        self._fill_dense(depths)

    def _child(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie's transition, or -1."""
        if not self.keys.size:
            return np.full(state.size, -1)
        key = state << 8 | byte
        place = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        return np.where(self.keys[place] == key, place + 1, -1)

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The automaton's transition."""
        out = np.empty(state.size, dtype=np.int64)
        todo, now = np.arange(state.size), state.astype(np.int64)
        while todo.size:
            shallow = now < len(self.dense)
            out[todo[shallow]] = self.dense[now[shallow], byte[todo[shallow]]]
            todo, now = todo[~shallow], now[~shallow]
            found = self._child(now, byte[todo])
            hit = (found >= 0) | (now == 0)
            out[todo[hit]] = np.maximum(found[hit], 0)
            todo, now = todo[~hit], self.fail[now[~hit]]
        return out

    def _fill_dense(self, depths: list[int]) -> None:
        n = min(self.n, DENSE)
        rows = np.zeros((n, 256), dtype=np.int32)
        of, byte = self.keys >> 8, self.keys & 255
        for lo, hi in zip([0, *depths[1:-1]], depths[1:]):
            states = np.arange(lo, min(hi, n))
            if not states.size:
                break
            if lo:
                rows[states] = rows[self.fail[states]]
            own = slice(np.searchsorted(of, lo), np.searchsorted(of, states[-1] + 1))
            rows[of[own], byte[own]] = np.arange(own.start, own.stop) + 1
        self.dense = rows

    def first_ranks(self, texts: pa.Array) -> np.ndarray:
        """Least rank of the keywords in each text (null: none)."""
        column = pc.fill_null(texts, "").cast(pa.large_string())
        _, offsets, values = column.buffers()
        offs = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(values, dtype=np.uint8) if values else np.zeros(0, np.uint8)
        out = np.full(len(column), self.best[0], dtype=np.int32)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE_BYTES, "right")) - 1)
            self._scan(data, offs[lo:hi + 1], out[lo:hi])
            lo = hi
        out[np.asarray(texts.is_null())] = NO_HIT
        return out

    def _scan(self, data: np.ndarray, offs: np.ndarray, out: np.ndarray) -> None:
        size = np.diff(offs)
        length = max(LANE, 4 * self.longest)
        lanes = -(-size // length)
        text = np.repeat(np.arange(size.size), lanes)
        nth = np.arange(text.size) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = np.maximum(offs[text], offs[text] + nth * length - max(0, self.longest - 1))
        stop = np.minimum(offs[text] + (nth + 1) * length, offs[text + 1])
        order = np.argsort(begin - stop, kind="stable")       # longest lanes first
        begin, text, steps = begin[order], text[order], (stop - begin)[order]
        state, least = np.zeros(text.size, dtype=np.int64), np.full(text.size, NO_HIT, dtype=np.int32)
        live = np.searchsorted(-steps, -np.arange(int(steps.max(initial=0))), "left")
        all_dense = len(self.dense) == self.n
        for i, n in enumerate(live.tolist()):
            byte = data[begin[:n] + i]
            state[:n] = self.dense[state[:n], byte] if all_dense else self._step(state[:n], byte.astype(np.int64))
            np.minimum(least[:n], self.best[state[:n]], out=least[:n])
        np.minimum.at(out, text, least)


def first_keyword(df: DataFrame, text_col: str, keywords: DataFrame, category: str = "category",
                  keyword: str = "keyword", order: tuple[str, ...] = ("cat_rank", "kw_rank"),
                  max_keywords: int = MAX_KEYWORDS) -> DataFrame:
    """Rows of ``df`` as a struct ``row``, with the first (category, keyword) in dictionary order (null: none).

    The dictionary is numbered once in its order; at most ``max_keywords`` of it reach the driver and a
    task at a time.
    """
    spark = df.sparkSession
    spots = [category, keyword, *order]
    keywords = keywords.where(F.col(keyword).isNotNull())
    n = keywords.count()
    root = f"{checkpoint_dir(spark)}/keywords-{uuid.uuid4().hex}"
    held = [F.struct("*").alias("row"), F.lit(None).cast("string").alias("category"),
            F.lit(None).cast("string").alias("keyword"), F.col(text_col).alias("text")]
    out = df.select(*held)
    passes = max(1, -(-n // max_keywords))
    ranked = keywords.select(*spots).orderBy(*order) if passes == 1 else \
        keywords.select(*spots).repartitionByRange(passes, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    for i in range(passes):
        part = (ranked if passes == 1 else ranked.where(F.spark_partition_id() == i)).toArrow()
        found, names = part[keyword].to_pylist(), part[category].to_pylist()
        scan = spark.sparkContext.broadcast((Automaton(found), pa.array(names, pa.string()), pa.array(found, pa.string())))
        out = out.mapInArrow(_scan(scan), out.schema)
        if passes > 1:  # one automaton in a task at a time; earlier passes' hits rank before this one's
            out.write.parquet(f"{root}/{i}")
            out = spark.read.schema(out.schema).parquet(f"{root}/{i}")
    return out.select("row", "category", "keyword")


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, names, found = shared.value
        for batch in batches:
            rank = automaton.first_ranks(batch["text"])
            at = pa.array(rank, pa.int32(), mask=rank == NO_HIT)
            old = batch["keyword"].is_valid()
            columns = {"category": pc.if_else(old, batch["category"], names.take(at)),
                       "keyword": pc.if_else(old, batch["keyword"], found.take(at))}
            yield pa.RecordBatch.from_arrays([columns.get(c, batch[c]) for c in batch.schema.names],
                                             names=batch.schema.names)
    return run


def add_first(df: DataFrame, lists: dict[str, tuple[Column, list[str]]]) -> DataFrame:
    """Adds, for each name, the first keyword of its list that its text contains (null: none).

    All lists are scanned in one visit of the rows, an automaton each.
    """
    texts = {f"_text_{i}": text for i, (text, _) in enumerate(lists.values())}
    out = df.select(F.struct("*").alias("_row"), *[x.alias(c) for c, x in texts.items()])
    n = len(lists)
    shared = df.sparkSession.sparkContext.broadcast(
        [(c, Automaton(words), pa.array(words, pa.string())) for c, (_, words) in zip(texts, lists.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [batch["_row"]]
            for c, automaton, words in shared.value:
                rank = automaton.first_ranks(batch[c])
                found.append(words.take(pa.array(rank, pa.int32(), mask=rank == NO_HIT)))
            yield pa.RecordBatch.from_arrays(found, names=["_row", *[f"_first_{i}" for i in range(n)]])

    schema = T.StructType([out.schema["_row"], *[T.StructField(f"_first_{i}", T.StringType()) for i in range(n)]])
    return out.mapInArrow(run, schema).select(
        "_row.*", *[F.col(f"_first_{i}").alias(name) for i, name in enumerate(lists)])
