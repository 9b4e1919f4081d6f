"""Exact Jaccard join of word-shingle sets by PartEnum signatures.

Two sets of sizes x and y with Jaccard similarity of at least t per cent differ
in at most (100 - t)(x + y) / (100 + t) elements.  Sizes are cut into bands; the
*instance* of a band serves all pairs whose larger set lies in it, so it knows a
bound k of their difference.  It cuts the domain of fingerprints into n1 ranges:
in one of them the sets differ in at most k2 = ceil((k + 1) / n1) - 1 elements.
Each range is cut into n2 > k2 parts, at least n2 - k2 of which then agree
entirely, so sets that are similar enough share the fingerprint of one
(n2 - k2)-subset of parts: a *signature*.  A set has signatures of its own band
and, if sets of the next band can reach it, of that.  No similar pair is lost,
whatever the data; n1 and n2 are chosen for the fewest signatures that still
stand for about LEAST_ELEMENTS elements.

Equal sets are one class from the start, and a group of near copies is linked
by its pivots: every member of a signature's bucket is compared with the
bucket's least node, then, in buckets that still span several components, with
four more, and what is left is compared block against block in one task each.
Before texts are fetched, pairs whose element counts by range differ too much
are dropped (the summed differences are a lower bound of the sets' own).  Every
pair of a bucket is compared or already connected.

Defined results: a null text is empty; a document without words has no
shingles, is linked with nothing and is its own component; a text of fewer
words than a shingle is one shingle; rows that repeat an id or a text are nodes
of their own and linked by their sets; a null id never names a component that
has another; an empty table gives no rows; columns other than the id and the
text are ignored, whatever their names.  Shingles are compared by 64-bit
fingerprints, whole sets by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.minhash import components
from chatlake.llm.shared import Scratch, arrow_batches
from chatlake.llm.words import LOWER, Texts, fingerprints, mix, text_slices

SHINGLE = 3
THRESHOLD_PCT = 90
#: Upper over lower size of a band (at least 100 / threshold).
BAND_RATIO = 1.25
#: Elements that a signature stands for, on average, in the smallest set of its band.
LEAST_ELEMENTS = 10
#: Ranges whose element counts are compared before the sets (a byte each).
RANGES = 256
#: Pivots of a bucket in each round, before the rest is compared in blocks ...
PIVOTS = (1, 4)
#: ... of about so many members and bytes of text.
BLOCK_MEMBERS, BLOCK_BYTES = 1024, 8 << 20
#: Rows of an Arrow batch: pairs carry two whole texts each.
ARROW_ROWS = 500

_WORD_WEIGHT = 0xA24BAED4963EE407
_SALT = 0x9FB21C651E98DF25


# ---------------------------------------------------------------- sets

def shingle_sets(texts: Texts, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text."""
    data = LOWER[texts.data]
    starts, ends, bounds = texts.words(data)
    words = fingerprints(data, starts, ends)
    weights = [np.uint64(pow(_WORD_WEIGHT, j + 1, 1 << 64)) for j in range(size)]
    windows = np.zeros(max(0, words.size - size + 1), dtype=np.uint64)
    for j, weight in enumerate(weights):
        windows += words[j:j + windows.size] * weight
    windows = mix(windows)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= size:
            yield np.unique(windows[lo:hi - size + 1])
        else:  # the whole sequence, told from windows by its length
            short = sum(int(words[lo + j]) * int(weights[j]) for j in range(hi - lo)) + (hi - lo) * _SALT
            yield mix(np.array([short % (1 << 64)][:hi - lo], dtype=np.uint64))


def range_counts(elements: np.ndarray) -> np.ndarray:
    """Elements in each of RANGES equal ranges of the domain, 255 at most.

    Counts so cut differ by no more than the counts themselves, so sets differ in at least the summed
    differences.
    """
    counts = np.bincount((elements >> np.uint64(56)).astype(np.int64), minlength=RANGES)
    return np.minimum(counts, 255).astype(np.uint8)


# ---------------------------------------------------------------- signatures

def difference_bound(x: int, y: int, threshold_pct: int) -> int:
    """The most elements in which similar sets of sizes x and y differ."""
    return (100 - threshold_pct) * (x + y) // (100 + threshold_pct)


class Instance:
    """Signatures for the pairs whose larger set has a size of low to high."""

    def __init__(self, number: int, low: int, high: int, threshold_pct: int) -> None:
        self.number, self.low, self.high = number, low, high
        self.k = difference_bound(high, high, threshold_pct)
        best = None
        for k2 in range(min(self.k, 4) + 1):
            n1 = -(-(self.k + 1) // (k2 + 1))
            for n2 in range(k2 + 1, k2 + 4):
                elements = low * (n2 - k2) / (n1 * n2)
                # Few signatures of enough elements; else as many elements as can be had.
                rank = (elements < LEAST_ELEMENTS, n1 * math.comb(n2, k2) if elements >= LEAST_ELEMENTS else -elements)
                if best is None or rank < best[0]:
                    best = rank, n1, n2, k2
        _, self.n1, self.n2, self.k2 = best
        n = self.n1 * self.n2
        self.edges = np.array([i * (1 << 64) // n for i in range(1, n)], dtype=np.uint64)
        self.subsets = list(combinations(range(self.n2), self.n2 - self.k2))
        tags = np.arange(self.n1 * len(self.subsets), dtype=np.uint64).reshape(self.n1, -1)
        self.tags = mix(mix(tags + np.uint64(1)) + np.uint64(number * _SALT % (1 << 64)))

    def signatures(self, elements: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Of a sorted set, ``sums`` being the running sums of its mixed elements (from 0)."""
        at = np.concatenate([[0], np.searchsorted(elements, self.edges), [elements.size]])
        parts = np.diff(sums[at]).reshape(self.n1, self.n2)
        found = [parts[:, list(s)].sum(axis=1, dtype=np.uint64) + self.tags[:, i] for i, s in enumerate(self.subsets)]
        return mix(np.concatenate(found))


@lru_cache(maxsize=4)
def _bands(threshold_pct: int, ratio: float) -> tuple[list[int], dict[int, Instance]]:
    return [1], {}


def instances(size: int, threshold_pct: int = THRESHOLD_PCT, ratio: float = BAND_RATIO) -> list[Instance]:
    """The instances in which a set of ``size`` elements has signatures (none where similar sets are equal sets)."""
    if ratio * threshold_pct < 100:
        raise ValueError("a band must reach from a size to the largest similar one")
    lows, made = _bands(threshold_pct, ratio)  # lows grows as larger sets come
    while lows[-1] <= size:
        lows.append(int(lows[-1] * ratio) + 1)
    own = int(np.searchsorted(lows, size, "right")) - 1
    if own + 2 > len(lows) - 1:
        lows.append(int(lows[-1] * ratio) + 1)
    wanted = [own] + [own + 1] * (100 * size >= threshold_pct * lows[own + 1])
    for i in wanted:
        if i not in made:
            made[i] = Instance(i, lows[i], lows[i + 1] - 1, threshold_pct)
    return [made[i] for i in wanted if made[i].k]


def signatures(elements: np.ndarray, threshold_pct: int = THRESHOLD_PCT, ratio: float = BAND_RATIO) -> np.ndarray:
    """All signatures of a sorted set."""
    if not elements.size:
        return elements
    sums = np.zeros(elements.size + 1, dtype=np.uint64)
    np.cumsum(mix(elements + np.uint64(_SALT)), out=sums[1:])
    found = [i.signatures(elements, sums) for i in instances(elements.size, threshold_pct, ratio)]
    return np.unique(np.concatenate(found)) if found else elements[:0]


def _sign(threshold_pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, first, second, counts, sigs = [], [], [], [], []
            for texts in text_slices(batch["text"]):
                for s in shingle_sets(texts):
                    size.append(s.size)
                    first.append(np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
                    second.append(np.sum(mix(s + np.uint64(0x14057B7EF767814F)), dtype=np.uint64))
                    counts.append(range_counts(s).tobytes())
                    sigs.append(signatures(s, threshold_pct).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array(size, pa.int64()),
                 *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (first, second)),
                 pa.array(counts, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "counts", "sigs"])
    return run


def _spell_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, node) of every signature."""
    for batch in batches:
        packed = batch["sigs"].to_pylist()
        sizes = np.array([len(x) // 8 for x in packed], dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.frombuffer(b"".join(packed), dtype=np.int64)),
             pa.array(np.repeat(batch["node"].to_numpy(), sizes))], names=["sig", "node"])


# ---------------------------------------------------------------- comparison

def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), RANGES).astype(np.int16)


def _room(counts: np.ndarray, size: np.ndarray, one: np.ndarray, one_size: np.ndarray, threshold_pct: int) -> np.ndarray:
    """Whether the counts leave room for similarity, row by row."""
    apart = np.abs(counts - one).sum(axis=1, dtype=np.int64)
    return (100 + threshold_pct) * apart <= (100 - threshold_pct) * (size + one_size)


def _prune(threshold_pct: int):
    """Pairs whose element counts leave room for their similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            left, right = _matrix(batch["counts_a"]), _matrix(batch["counts_b"])
            sizes = (batch[c].to_numpy() for c in ("n_shingles_a", "n_shingles_b"))
            keep = pa.array(np.flatnonzero(_room(left, next(sizes), right, next(sizes), threshold_pct)))
            yield pa.RecordBatch.from_arrays([batch["a"].take(keep), batch["b"].take(keep)], names=["a", "b"])
    return run


def similar(one: np.ndarray, other: np.ndarray, threshold_pct: int) -> bool:
    shared = np.intersect1d(one, other, assume_unique=True).size
    return 100 * shared >= threshold_pct * (one.size + other.size - shared)


def _sets(texts: pa.Array) -> list[np.ndarray]:
    return [s for part in text_slices(texts) for s in shingle_sets(part)]


def _verify(threshold_pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, place = np.unique(batch["a"].to_numpy(), return_index=True)
            left = dict(zip(head.tolist(), _sets(batch["text_a"].take(pa.array(place)))))
            right = _sets(batch["text_b"])
            found = [i for i, (a, s) in enumerate(zip(batch["a"].to_pylist(), right))
                     if similar(left[a], s, threshold_pct)]
            keep = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["a"].take(keep), batch["b"].take(keep)], names=["a", "b"])
    return run


class Block:
    """Some members of one bucket."""

    def __init__(self, table: pa.Table) -> None:
        self.node, self.comp = table["node"].to_numpy(), table["comp"].to_numpy()
        self.size = table["n_shingles"].to_numpy()
        self.counts = _matrix(table["counts"].combine_chunks())
        self.texts = table["text"].combine_chunks() if "text" in table.column_names else None

    def sets(self, threshold_pct: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each member's set and signatures."""
        return [(s, signatures(s, threshold_pct)) for s in _sets(self.texts)]


def _both(table: pa.Table) -> tuple[Block, Block]:
    """The group's two blocks (the same one twice, if it is compared with itself)."""
    one, two = table["one"][0].as_py(), table["two"][0].as_py()
    slot = table["slot"].to_numpy()
    left = Block(table.filter(pa.array(slot == one)))
    return left, left if one == two else Block(table.filter(pa.array(slot == two)))


def _near(left: Block, right: Block, i: int, threshold_pct: int) -> np.ndarray:
    """Members of ``right`` that member i of ``left`` must still be compared with."""
    rows = np.arange(i + 1 if right is left else 0, right.node.size)
    rows = rows[right.comp[rows] != left.comp[i]]
    return rows[_room(right.counts[rows], right.size[rows], left.counts[i], left.size[i], threshold_pct)]


def _block_candidates(threshold_pct: int):
    """The members of two blocks whose counts leave room for a link between the blocks."""
    def run(table: pa.Table) -> pa.Table:
        left, right = _both(table)
        found: set[int] = set()
        for i in range(left.node.size):
            rows = _near(left, right, i, threshold_pct)
            if rows.size:
                found.add(int(left.node[i]))
                found.update(right.node[rows].tolist())
        out = pa.array(sorted(found), pa.int64())
        same = [pa.array([table[c][0].as_py()] * len(out), table.schema.field(c).type) for c in ("sig", "one", "two")]
        return pa.table([*same, out], names=["sig", "one", "two", "node"])
    return run


def _block_links(threshold_pct: int):
    """Links between two blocks, by the sets of the texts."""
    def run(table: pa.Table) -> pa.Table:
        left, right = _both(table)
        one = left.sets(threshold_pct)
        two = one if right is left else right.sets(threshold_pct)
        own = np.uint64(table["sig"][0].as_py() % (1 << 64))
        a, b = [], []
        for i in range(left.node.size):
            for j in _near(left, right, i, threshold_pct).tolist():
                # A pair that shares several signatures is compared in the bucket of the least.
                if (np.intersect1d(one[i][1], two[j][1], assume_unique=True)[0] == own
                        and similar(one[i][0], two[j][0], threshold_pct)):
                    a.append(min(left.node[i], right.node[j]))
                    b.append(max(left.node[i], right.node[j]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(sig, node, comp) of the buckets that span several components."""
    if labels is None:
        named = members.select("sig", "node", F.col("node").alias("comp"))
    else:
        named = members.join(labels, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("comp"))
    bucket = Window.partitionBy("sig")
    return (named.withColumn("low", F.min("comp").over(bucket)).withColumn("high", F.max("comp").over(bucket))
            .filter("low < high").select("sig", "node", "comp"))


class Join:
    """One run's tables: classes of equal sets (nodes), their signatures, and the links found so far."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, threshold_pct: int) -> None:
        self.scratch, self.pct = Scratch(docs.sparkSession, "partenum"), threshold_pct
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                                F.xxhash64(F.col(text_col)).alias("text_hash"))
        save = self.scratch.save
        self.signed = save(
            self.docs.mapInArrow(_sign(threshold_pct), "doc_id long, text_hash long, n_shingles long, set_a long, "
                                                       "set_b long, counts binary, sigs binary")
            .withColumn("row", F.monotonically_increasing_id()), "signed")
        head = F.min(F.struct("row", "doc_id", "text_hash"))
        self.classes = save(
            self.signed.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles")
            .agg(F.min("doc_id").alias("min_id"), head.alias("head"))
            .select("set_a", "set_b", "n_shingles", "min_id", "head.*")
            .withColumn("node", F.monotonically_increasing_id()), "classes")
        every = (self.signed.filter("octet_length(sigs) > 0").select("row", "sigs")
                 .join(self.classes.select("row", "node"), "row").select("node", "sigs")
                 .mapInArrow(_spell_out, "sig long, node long"))
        self.members = save(_open(every, None).select("sig", "node"), "members")
        wanted = self.classes.join(self.members.select("node").distinct(), "node")
        self.counts = save(self.signed.select("row", "n_shingles", "counts").join(wanted.select("row", "node"), "row")
                           .drop("row"), "counts")
        # A text is fetched by its id and hash, so that copies under many ids do not meet in one task.
        keys = wanted.select("node", F.col("doc_id").alias("head_id"), F.col("text_hash").alias("head_hash"))
        same = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("text_hash") == F.col("head_hash"))
        self.texts = save(self.docs.filter("text IS NOT NULL").join(keys, same).groupBy("node")
                          .agg(F.min("text").alias("text")), "texts")
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def add(self, found: DataFrame) -> None:
        """Write links and join the components that they connect."""
        found = self.scratch.save(found, "links")
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.union(found)
            self.labels = self.scratch.save(components(self.links, self.scratch), "labels")

    def compare(self, pairs: DataFrame) -> None:
        """Links of node pairs: first by counts, then by the sets of the texts."""
        of = lambda table, x, *c: table.select(F.col("node").alias(x), *[F.col(y).alias(f"{y}_{x}") for y in c])
        pairs = self.scratch.save(pairs, "pairs")
        near = self.scratch.save(
            pairs.join(of(self.counts, "a", "n_shingles", "counts"), "a")
            .join(of(self.counts, "b", "n_shingles", "counts"), "b").mapInArrow(_prune(self.pct), "a long, b long"), "near")
        self.add(near.join(of(self.texts, "b", "text"), "b").join(of(self.texts, "a", "text"), "a")
                 .select("a", "b", "text_a", "text_b").mapInArrow(_verify(self.pct), "a long, b long"))

    def run(self) -> None:
        members = self.members
        for turn, per_bucket in enumerate(PIVOTS):
            active = self.scratch.save(_open(members, self.labels), "active")
            if active.isEmpty():
                return
            order = F.xxhash64("node", F.lit(turn))
            pivots = (active.groupBy("sig", F.pmod(order, F.lit(per_bucket)).alias("slot"))
                      .agg(F.min(F.struct(order.alias("order"), "node", "comp")).alias("p"))
                      .select("sig", F.col("p.node").alias("pivot"), F.col("p.comp").alias("pivot_comp")))
            pivots = self.scratch.save(pivots, "pivots")
            met = active.join(pivots, "sig").filter("comp <> pivot_comp")
            self.compare(met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())
            # A pivot has met all of its bucket that it wasn't connected with.
            members = active.select("sig", "node").join(
                pivots.select("sig", F.col("pivot").alias("node")), ["sig", "node"], "left_anti")
        active = self.scratch.save(_open(members, self.labels), "active")
        if not active.isEmpty():
            self.compare_blocks(active)

    def compare_blocks(self, active: DataFrame) -> None:
        sizes = self.texts.select("node", F.octet_length("text").alias("bytes"))
        parts = (active.join(sizes, "node").groupBy("sig")
                 .agg(F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("bytes") / BLOCK_BYTES))
                      .cast("int").alias("parts")))
        dealt = (active.join(parts, "sig")
                 .withColumn("slot", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                 .select("sig", "node", "comp", "slot", F.least("slot", "other").alias("one"),
                         F.greatest("slot", "other").alias("two")))
        # First without texts: few members are near any of another component.
        dealt = self.scratch.save(dealt.join(self.counts, "node"), "dealt")
        group = ["sig", "one", "two"]
        near = dealt.groupBy(*group).applyInArrow(_block_candidates(self.pct), "sig long, one int, two int, node long")
        self.add(dealt.join(near, [*group, "node"]).join(self.texts, "node").groupBy(*group)
                 .applyInArrow(_block_links(self.pct), "a long, b long"))

    def rows(self) -> DataFrame:
        """doc_id, n_shingles and component_id of every document."""
        named = self.classes.select("set_a", "set_b", "n_shingles", "node", "min_id")
        if self.labels is None:
            named = named.withColumnRenamed("min_id", "least")
        else:
            named = named.join(self.labels, "node", "left").withColumn("comp", F.coalesce("root", "node"))
            named = named.join(named.groupBy("comp").agg(F.min("min_id").alias("least")), "comp")
        named = named.select(*[F.col(c).alias(f"of_{c}") for c in ("set_a", "set_b", "n_shingles")], "least")
        same = [F.col(c) == F.col(f"of_{c}") for c in ("set_a", "set_b", "n_shingles")]
        component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least"))
        return self.signed.join(named, same, "left").select("doc_id", "n_shingles", component.alias("component_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       threshold_pct: int = THRESHOLD_PCT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links) of every row of ``docs``."""
    with arrow_batches(docs.sparkSession, ARROW_ROWS):  # every Arrow step is written before this ends
        join = Join(docs, id_col, text_col, threshold_pct)
        join.run()
        return join.rows()
