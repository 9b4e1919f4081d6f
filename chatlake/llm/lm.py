"""Log-bilinear language model: trained by noise-contrastive estimation, scored exactly.

Words are lower-cased A-Z; every text ends with an end token.  The most frequent
words are symbols of the model; other words share a symbol with those of the
same ending, and are told apart within it by their add-one count.  A symbol's
score in the context of the two before it is log-bilinear,

    s(w | u, v) = (c1 * r_u + c2 * r_v) . q_w + b_w .

*Counting* covers all training texts: words (by 64-bit fingerprint) are counted
in the tasks, summed by a shuffle and kept as a table.

*Training* covers them too.  Each round takes its share of the texts; each task
runs mini-batches from the common start with noise drawn from the unigram
distribution and shared by the batch, so a step is three matrix products; the
tasks' models are averaged, weighted by tokens, in a shuffle by parameter block.

*Scoring* is normalised: for all pairs of contexts at once the normaliser is one
matrix product, exp(R1 Q' + b) exp(R2 Q')', so a token takes three look-ups.

Counts of the words above a frequency (``COMMON`` words at most) are broadcast;
the rest of a text's words are joined with the table.

Defined results: a null or empty text is its end token; a null id trains; without
training texts every symbol is equally likely; repeated rows count repeatedly.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.shared import Scratch
from chatlake.llm.words import LOWER, Texts, fingerprints, mix, per_text, spread, text_slices

#: Words with a symbol of their own, and symbols shared by ending.
SYMBOLS, ENDINGS = 2047, 64
DIMENSIONS = 16
#: Bound of the broadcast count table, in words.
COMMON = 400_000
ROUNDS = 3
NOISE, BATCH, RATE = 128, 2048, 0.05
COUNTED_AT_ONCE = 1 << 21
BLOCK = 4096

END = np.uint64(0x5EED0F7EC57)
HELD_OUT = "pmod(crc32(cast(cast(id as string) as binary)), 7) = 2"


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and ending of each token, end tokens included, and each text's bounds."""
    data = LOWER[texts.data]
    starts, ends, bounds = texts.words(data)
    last = data[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    ending = (mix((last * 256 + before).astype(np.uint64)) % np.uint64(ENDINGS)).astype(np.int64)
    stops = bounds[1:]
    where = stops + np.arange(texts.n)
    size = starts.size + texts.n
    word = np.ones(size, dtype=bool)
    word[where] = False
    out, kind = np.full(size, END, dtype=np.uint64), np.full(size, ENDINGS, dtype=np.int64)
    out[word], kind[word] = fingerprints(data, starts, ends), ending
    return out, kind, np.append(0, where + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        word, ending = (np.concatenate(x) for x in zip(*held))
        held.clear()
        word, first, n = np.unique(word, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(ending[first]), pa.array(n)],
                                          names=["word", "ending", "n"])

    for batch in batches:
        for texts in text_slices(batch["text"]):
            word, ending, _ = tokens(texts)
            held.append((word, ending))
            size += word.size
            if size >= COUNTED_AT_ONCE:
                yield flush()
                size = 0
    if held:
        yield flush()


class Vocabulary:
    """Bounded look-up tables: counts of common words, symbols, and each ending's mass."""

    def __init__(self, word: np.ndarray, count: np.ndarray, ending: np.ndarray, ends: int,
                 mass: dict[int, tuple[int, int]]) -> None:
        """``mass``: (tokens, words) of each ending over all training words."""
        order = np.lexsort((word, -count))[:SYMBOLS]
        symbol = ending.copy() + SYMBOLS
        symbol[order] = np.arange(order.size)
        self.size = SYMBOLS + ENDINGS + 1
        uses = np.zeros(self.size)
        kinds = np.zeros(ENDINGS)
        for e, (n, v) in mass.items():
            uses[SYMBOLS + e], kinds[e] = n, v
        np.subtract.at(uses, SYMBOLS + ending[order], count[order])
        np.subtract.at(kinds, ending[order], 1)
        uses[:order.size] = count[order]
        self.rest = np.log10(uses[SYMBOLS:SYMBOLS + ENDINGS] + kinds + 1)
        uses[-1] = ends
        self.uses = uses
        word, count, symbol = np.append(word, END), np.append(count, ends), np.append(symbol, self.size - 1)
        at = np.argsort(word)
        self.word, self.symbol = word[at], symbol[at].astype(np.int32)
        self.count = count[at]
        self.log_count = np.log10(count[at] + 1.0)

    def find(self, word: np.ndarray) -> np.ndarray:
        """Place in the tables; -1 for other words."""
        at = np.minimum(np.searchsorted(self.word, word), self.word.size - 1)
        return np.where(self.word[at] == word, at, -1)

    def symbols(self, place: np.ndarray, ending: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.symbol[place], SYMBOLS + ending)


def contexts(symbol: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two before each token; texts begin after an end token."""
    one = np.append(end, symbol[:-1])
    two = np.append(end, one[:-1])
    two[bounds[:-1]] = end
    return one, two


class Model:
    """Parameters as one vector, so that tasks can average them by blocks."""

    def __init__(self, size: int, values: np.ndarray) -> None:
        d = DIMENSIONS
        self.values = values
        self.context = values[:size * d].reshape(size, d)
        self.output = values[size * d:2 * size * d].reshape(size, d)
        self.bias = values[2 * size * d:2 * size * d + size]
        self.one, self.two = values[-2 * d:-d], values[-d:]

    @classmethod
    def start(cls, uses: np.ndarray) -> Model:
        """The unigram model: no output vectors yet."""
        size, d = uses.size, DIMENSIONS
        model = cls(size, np.zeros(2 * size * d + size + 2 * d, dtype=np.float32))
        model.context[:] = np.random.default_rng(7).normal(0, 0.5, (size, d))
        model.bias[:] = np.log((uses + 1) / (uses + 1).sum())
        model.one[:], model.two[:] = 1.0, 0.5
        return model

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by (one before, word) and (two before, word), and log normalisers by context pair."""
        first = (self.context * self.one) @ self.output.T + self.bias
        second = (self.context * self.two) @ self.output.T
        up, down = first.max(axis=1, keepdims=True), second.max(axis=1, keepdims=True)
        norm = np.log(np.exp((first - up).astype(np.float64)) @ np.exp((second - down).astype(np.float64)).T)
        return first, second, (norm + up + down.T).astype(np.float32)


class Trainer:
    """Mini-batch noise-contrastive estimation with per-parameter step sizes (Adagrad)."""

    def __init__(self, values: np.ndarray, uses: np.ndarray, seed: int) -> None:
        self.model = Model(uses.size, values.astype(np.float32).copy())
        self.squares = np.full(values.size, 1.0, dtype=np.float32)
        self.rng = np.random.default_rng(seed)
        share = (uses + 1) / (uses + 1).sum()
        self.cumulative = np.cumsum(share)
        self.log_noise = np.log(share * NOISE).astype(np.float32)
        self.seen = 0

    def learn(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        order = self.rng.permutation(word.size)
        for i in range(0, word.size, BATCH):
            at = order[i:i + BATCH]
            self.step(word[at], one[at], two[at])
        self.seen += word.size

    def step(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m = self.model
        size, d = m.context.shape
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), size - 1)
        r1, r2 = m.context[one], m.context[two]
        predicted = r1 * m.one + r2 * m.two
        target, other = m.output[word], m.output[noise]
        real = np.einsum("ij,ij->i", predicted, target) + m.bias[word] - self.log_noise[word]
        false = predicted @ other.T + (m.bias[noise] - self.log_noise[noise])
        g_real = 1 / (1 + np.exp(real))
        g_false = -1 / (1 + np.exp(-false))
        back = g_real[:, None] * target + g_false @ other
        grad = np.zeros_like(m.values)
        g = Model(size, grad)
        rows = lambda at, x: _scatter(at, x, size)
        g.context[:] = rows(one, back * m.one) + rows(two, back * m.two)
        g.output[:] = rows(word, g_real[:, None] * predicted) + rows(noise, g_false.T @ predicted)
        g.bias[:] = np.bincount(word, g_real, size) + np.bincount(noise, g_false.sum(axis=0), size)
        g.one[:], g.two[:] = (back * r1).sum(axis=0), (back * r2).sum(axis=0)
        self.squares += grad * grad
        m.values += RATE * grad / np.sqrt(self.squares)


def _scatter(at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``x`` by index."""
    d = x.shape[1]
    flat = (at[:, None] * d + np.arange(d)).ravel()
    return np.bincount(flat, x.ravel(), size * d).reshape(size, d)


def _train(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, values = shared.value
        context = TaskContext.get()
        trainer = Trainer(values, vocabulary.uses, context.partitionId() if context else 0)
        for batch in batches:
            for texts in text_slices(batch["text"]):
                word, ending, bounds = tokens(texts)
                symbol = vocabulary.symbols(vocabulary.find(word), ending)
                trainer.learn(symbol, *contexts(symbol, bounds, vocabulary.size - 1))
        if trainer.seen:
            total = trainer.model.values.astype(np.float64) * trainer.seen
            parts = [total[i:i + BLOCK] for i in range(0, total.size, BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([float(trainer.seen)] * len(parts)),
                 pa.array(parts, pa.list_(pa.float64()))], names=["block", "weight", "total"])
    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks that stream through the task."""
    sums: dict[int, tuple[float, np.ndarray]] = {}
    for batch in batches:
        for block, weight, total in zip(batch["block"].to_pylist(), batch["weight"].to_pylist(), batch["total"]):
            w, t = sums.get(block, (0.0, 0.0))
            sums[block] = (w + weight, t + total.values.to_numpy())
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums, pa.int32()), pa.array([w for w, _ in sums.values()]),
             pa.array([t for _, t in sums.values()], pa.list_(pa.float64()))], names=["block", "weight", "total"])


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Averaged parameters after each round over its share of ``texts`` (id, text)."""
    sc = texts.sparkSession.sparkContext
    values = Model.start(vocabulary.uses).values
    schema = "block int, weight double, total array<double>"
    n_blocks = -(-values.size // BLOCK)
    for r in range(rounds):
        shared = sc.broadcast((vocabulary, values))
        share = texts.filter(F.pmod(F.xxhash64("id", "text"), F.lit(rounds)) == r).select("text")
        found = (share.mapInArrow(_train(shared), schema).repartition(n_blocks, "block")
                 .mapInArrow(_add, schema).toArrow())
        for block, weight, total in zip(found["block"].to_pylist(), found["weight"].to_pylist(),
                                        found["total"].to_pylist()):
            values[block * BLOCK:block * BLOCK + len(total)] = np.array(total) / weight
        shared.destroy()
    return values


_TABLES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _tables(vocabulary: Vocabulary, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model's tables, made once in a worker."""
    key = zlib.crc32(values.tobytes())
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = Model(vocabulary.size, values).tables()
    return _TABLES[key]


def _score(shared, total: int, distinct: int):
    floor = math.log10(total + distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, values = shared.value
        first, second, norm = _tables(vocabulary, values)
        end = vocabulary.size - 1
        for batch in batches:
            parts: list[list[np.ndarray]] = [[np.zeros(0, dtype=t)] for t in (int, int, float, float, int, int, int)]
            for texts in text_slices(batch["text"]):
                word, ending, bounds = tokens(texts)
                place = vocabulary.find(word)
                symbol = vocabulary.symbols(place, ending)
                one, two = contexts(symbol, bounds, end)
                ln = (first[one, symbol] + second[two, symbol] - norm[one, two]).astype(np.float64)
                counted = np.where(place >= 0, vocabulary.log_count[place], 0.0)
                shared_symbol = (symbol >= SYMBOLS) & (symbol != end)
                within = np.where(shared_symbol, counted - vocabulary.rest[np.minimum(ending, ENDINGS - 1)], 0.0)
                known = (place >= 0) & (vocabulary.count[place] > 0)
                # The words that the broadcast table lacks, with their number in each text.
                lacking = np.flatnonzero(place < 0)
                text, rare = spread(bounds)[lacking], word[lacking]
                order = np.lexsort((rare, text))
                text, rare = text[order], rare[order]
                new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (rare[1:] != rare[:-1]))[:text.size])
                for p, x in zip(parts, (
                        np.diff(bounds), per_text(known.astype(np.int64), bounds),
                        per_text(counted, bounds) - np.diff(bounds) * floor,
                        per_text(ln / math.log(10) + within, bounds),
                        np.bincount(text[new], minlength=texts.n),
                        rare[new].view(np.int64), np.diff(np.append(new, text.size)))):
                    p.append(x)
            n, known, base, score, lists, rare, times = (np.concatenate(p) for p in parts)
            offsets = pa.array(np.append(0, np.cumsum(lists)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["held_out"], pa.array(n), pa.array(known), pa.array(base), pa.array(score),
                 pa.ListArray.from_arrays(offsets, pa.array(rare, pa.int64())),
                 pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))],
                names=["id", "held_out", "n_tokens", "known", "base", "score", "rare", "times"])
    return run


def fit(texts: DataFrame, scratch: Scratch) -> tuple[Vocabulary, np.ndarray, DataFrame, int, int]:
    """Vocabulary, parameters, count table (word, ending, c), tokens and distinct tokens of (id, text)."""
    counts = scratch.save(
        texts.select("text").mapInArrow(_count, "word long, ending long, n long")
        .groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("c")), "counts")
    mass = {r["ending"]: (r["n"], r["v"]) for r in
            counts.groupBy("ending").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    ends = mass.pop(ENDINGS, (0, 0))
    total, distinct = ends[0] + sum(n for n, _ in mass.values()), ends[1] + sum(v for _, v in mass.values())
    # The least count of which, and above, there are no more than COMMON words.
    by_count = counts.groupBy("c").agg(F.count("*").alias("v"))
    up_to = F.sum("v").over(Window.orderBy(F.col("c").desc()))
    least = by_count.withColumn("up_to", up_to).filter(F.col("up_to") <= COMMON).agg(F.min("c")).first()[0]
    common = counts.filter((F.col("c") >= (least or 0)) & (F.col("ending") != ENDINGS) & F.lit(least is not None)) \
        .toArrow()
    vocabulary = Vocabulary(common["word"].to_numpy().view(np.uint64), common["c"].to_numpy(),
                            common["ending"].to_numpy(), ends[0], mass)
    return vocabulary, train(texts, vocabulary), counts, total, distinct


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(F.expr(HELD_OUT), F.lit(False)))
    vocabulary, values, counts, total, distinct = fit(rows.filter("not held_out").select("id", "text"), scratch)
    shared = spark.sparkContext.broadcast((vocabulary, values))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(
        _score(shared, total, distinct), f"id {kind}, held_out boolean, n_tokens long, known long, base double, "
        "score double, rare array<long>, times array<long>").withColumn("row", F.monotonically_increasing_id())
    scored = scratch.save(scored, "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")) \
        .select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("n"))
    seen = (rare.join(counts.select("word", "c"), "word").groupBy("row")
            .agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("seen")))
    more = F.coalesce("more", F.lit(0.0))
    return (scored.select("row", "id", "held_out", "n_tokens", "known", "base", "score").join(seen, "row", "left")
            .select("id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
                    F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
                    (F.col("score") + more).alias("score")))
