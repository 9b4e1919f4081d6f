"""MinHash near-duplicate groups with sequential Bayesian verification.

Documents are sets of five-word shingles (lower-cased A-Z; with fewer words the
whole sequence is one shingle).  Equal sets are one *class* from the start, so
exact copies are never compared.  Classes sharing a band of their MinHash
signatures become candidates; a candidate's signatures are compared batch by
batch and the pair is pruned once the posterior probability of reaching the
threshold falls below the chosen miss probability; survivors are verified on
their full shingle sets.  Linked classes form components.

Pairs of a bucket are not emitted.  In two rounds, each bucket that spans several
components compares one pivot, then four, with the members of *other*
components, retires the pivots and merges what was linked; a group of thousands
of near copies is one component by then.  What is left, buckets of documents
that mostly stay unlinked, is compared in blocks of bounded rows and bytes:
block against block in one task, with signatures and texts at hand, so only
links come out.  A pair that shares several buckets is compared in the first of
its bands.  Every pair of a bucket is thus tested or already connected, and no
link between two components is lost to a cap.

Defined results: a null text is empty; a document without words has no
shingles, is linked with nothing and is its own component; rows repeating a
``doc_id`` share its component if their texts are linked; a null ``doc_id`` row
is grouped by its text, never names a component unless all its members are
null, and is kept only then.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.shared import Scratch, arrow_batches
from chatlake.llm.words import LOWER, Texts, fingerprints, mix, text_slices

SHINGLE = 5
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
THRESHOLD_PCT = 75
MISS_PROBABILITY = 1e-6
#: Pivots of a bucket in each round, before what is left is compared in blocks ...
PIVOTS = (1, 4)
#: ... of at most about so many members and bytes of text.
BLOCK_MEMBERS, BLOCK_BYTES = 256, 8 << 20
BATCH = 25
#: Rows of an Arrow batch: pairs carry two whole texts each.
ARROW_ROWS = 1000

_rng = np.random.Generator(np.random.PCG64(20240501))
_WEIGHTS = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_TIMES = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_BAND_WEIGHTS = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def shingle_sets(texts: Texts) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text."""
    data = LOWER[texts.data]
    starts, ends, bounds = texts.words(data)
    words = fingerprints(data, starts, ends)
    n = max(0, words.size - SHINGLE + 1)
    windows = np.zeros(n, dtype=np.uint64)
    for j in range(SHINGLE):
        windows += words[j:j + n] * _WEIGHTS[j]
    windows = mix(windows)
    for i in range(texts.n):
        lo, hi = bounds[i], bounds[i + 1]
        if hi - lo >= SHINGLE:
            yield np.unique(windows[lo:hi - SHINGLE + 1])
        elif hi > lo:
            short = np.sum(words[lo:hi] * _WEIGHTS[:hi - lo], dtype=np.uint64)
            yield mix(np.array([short ^ np.uint64(hi - lo)]))
        else:
            yield windows[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """200 MinHash values, in steps of bounded size for long sets."""
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, short.size, 2048):
        np.minimum(low, ((short[i:i + 2048, None] ^ _FLIP) * _TIMES).min(axis=0), out=low)
    return low


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, first, second, sigs = [], [], [], []
        for texts in text_slices(batch["text"]):
            for s in shingle_sets(texts):
                size.append(s.size)
                first.append(np.sum(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64))
                second.append(np.sum(mix(s + np.uint64(0x1234567890ABCDEF)), dtype=np.uint64))
                sigs.append(signature(s).tobytes() if s.size >= 3 else None)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["text_hash"], pa.array(size, pa.int64()),
             pa.array(np.array(first, dtype=np.uint64).view(np.int64)),
             pa.array(np.array(second, dtype=np.uint64).view(np.int64)), pa.array(sigs, pa.binary())],
            names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "sig"])


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """The bucket of each signature in each band."""
    cut = sigs.astype(np.uint64).reshape(-1, BANDS, ROWS)
    return mix((cut * _BAND_WEIGHTS).sum(axis=2, dtype=np.uint64) ^ _BAND_SALT)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        keys = band_keys(_matrix(batch["sig"]))
        nodes = batch["node"].to_numpy()
        for i in range(0, BANDS, 8):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[:, i:i + 8].reshape(-1).view(np.int64)),
                 pa.array(np.repeat(nodes, min(8, BANDS - i)))], names=["bucket", "node"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), HASHES)


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(compared, least matches) by batch: fewer matches are pruned.

    With a uniform prior, m matches in n hashes leave the similarity
    Beta(m + 1, n - m + 1), which reaches ``threshold`` with probability
    P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _prune(threshold_pct: int, miss: float):
    bounds = least_matches(threshold_pct / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            left, right = _matrix(batch["sig_a"]), _matrix(batch["sig_b"])
            alive = np.arange(len(batch))
            same = np.zeros(len(batch), dtype=np.int64)
            done = 0
            for n, least in bounds:
                same[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
                alive, done = alive[same[alive] >= least], n
            keep = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch["a"].take(keep), batch["b"].take(keep)], names=["a", "b"])

    return run


class Members:
    """Some members of one bucket, ready to be compared."""

    def __init__(self, table: pa.Table) -> None:
        self.node, self.comp = table["node"].to_numpy(), table["comp"].to_numpy()
        self.sig = _matrix(table["sig"].combine_chunks())
        self.keys = band_keys(self.sig)
        self.sets = [s for texts in text_slices(table["text"].combine_chunks()) for s in shingle_sets(texts)]
        self.size = np.array([s.size for s in self.sets], dtype=np.int64)


def linked(one: Members, i: int, other: Members, rows: np.ndarray, bounds: list[tuple[int, int]],
           threshold_pct: int) -> np.ndarray:
    """Of ``rows`` of ``other``, those linked with member ``i`` of ``one``."""
    size = one.sets[i].size
    rows = rows[100 * np.minimum(size, other.size[rows]) >= threshold_pct * np.maximum(size, other.size[rows])]
    same, done = np.zeros(rows.size, dtype=np.int64), 0
    for n, least in bounds:
        same += (other.sig[rows, done:n] == one.sig[i, done:n]).sum(axis=1)
        rows, same, done = rows[same >= least], same[same >= least], n
    if not rows.size:
        return rows
    found = np.concatenate([other.sets[j] for j in rows.tolist()])
    at = np.minimum(np.searchsorted(one.sets[i], found), size - 1)
    inside = np.add.reduceat(one.sets[i][at] == found, np.append(0, np.cumsum(other.size[rows])[:-1]), dtype=np.int64)
    return rows[100 * inside >= threshold_pct * (size + other.size[rows] - inside)]


def _blocks(threshold_pct: int, miss: float):
    """Links between the two blocks of members in a group, or within its one block."""
    bounds = least_matches(threshold_pct / 100, miss)

    def run(table: pa.Table) -> pa.Table:
        left_slot, right_slot = table["one"][0].as_py(), table["two"][0].as_py()
        slot = table["slot"].to_numpy()
        left = Members(table.filter(pa.array(slot == left_slot)))
        right = left if left_slot == right_slot else Members(table.filter(pa.array(slot == right_slot)))
        a, b = [], []
        if left.node.size and right.node.size:
            band = int(np.flatnonzero(left.keys[0] == np.uint64(table["bucket"][0].as_py() % (1 << 64)))[0])
            for i in range(left.node.size):
                rows = np.arange(i + 1 if right is left else 0, right.node.size)
                rows = rows[right.comp[rows] != left.comp[i]]
                # Pairs that agree in an earlier band are compared there.
                rows = rows[~(right.keys[rows, :band] == left.keys[i, :band]).any(axis=1)]
                for j in linked(left, i, right, rows, bounds, threshold_pct).tolist():
                    a.append(min(left.node[i], right.node[j]))
                    b.append(max(left.node[i], right.node[j]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _one_set(text: str) -> np.ndarray:
    return next(iter(shingle_sets(next(text_slices(pa.array([text]), 1)))))


def _verify(threshold_pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            found = []
            for i, (a, one, other) in enumerate(zip(batch["a"].to_pylist(), batch["text_a"], batch["text_b"])):
                if a != last:
                    last, held = a, _one_set(one.as_py())
                s = _one_set(other.as_py())
                shared = np.intersect1d(held, s, assume_unique=True).size
                if 100 * shared >= threshold_pct * (held.size + s.size - shared):
                    found.append(i)
            keep = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["a"].take(keep), batch["b"].take(keep)], names=["a", "b"])

    return run


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the smallest node it reaches.

    Alternating large-star and small-star steps; each step is a grouped minimum
    and a join, so a hub of any size is summed before it is shuffled.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                       .filter("u <> v").distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = (near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(near.select("u", F.col("m").alias("v"))).distinct())
        new = scratch.save(small, "edges")
        scratch.drop(now)
        now = new
        # A forest of stars: every node points at one root, and no root points on.
        more = now.join(now.select(F.col("u").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi")
        twice = now.groupBy("u").count().filter("count > 1").select("u")
        if more.select("u").union(twice).isEmpty():
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _ordered_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(bucket, node, comp) of the buckets that span several components."""
    if labels is not None:
        members = members.join(labels, "node", "left") \
            .select("bucket", "node", F.coalesce("root", "node").alias("comp"))
    else:
        members = members.withColumn("comp", F.col("node"))
    wide = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    return members.join(wide.select("bucket"), "bucket")


def _merge(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, root) after ``links``: linked nodes are contracted to their components, and those are joined."""
    if links.isEmpty():
        return labels
    if labels is None:
        return scratch.save(components(links, scratch), "labels")
    name = lambda x: labels.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    between = (links.join(name("a"), "a", "left").join(name("b"), "b", "left")
               .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    merged = components(between, scratch).withColumnRenamed("root", "to")
    old = (labels.join(merged.withColumnRenamed("node", "root"), "root", "left")
           .select("node", F.coalesce("to", "root").alias("root")))
    new = merged.join(labels.select("node"), "node", "left_anti").select("node", F.col("to").alias("root"))
    return scratch.save(old.union(new), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold_pct: int = THRESHOLD_PCT, miss: float = MISS_PROBABILITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    A pair at the threshold misses all 40 bands of 5 with probability
    (1 - 0.75 ** 5) ** 40 = 2e-5 and is pruned with at most ``miss``.
    """
    with arrow_batches(docs.sparkSession, ARROW_ROWS):  # every Arrow step is written before this ends
        return _near_duplicates(docs, id_col, text_col, threshold_pct, miss) \
            .select("doc_id", "n_shingles", "component_id", "kept")


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, threshold_pct: int, miss: float) -> DataFrame:
    """As near_duplicates, with text_hash and ``comp``: the component's own key, null without shingles."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         F.xxhash64(F.col(text_col)).alias("text_hash"))
    signed = scratch.save(
        source.mapInArrow(_sign, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, sig binary")
        .withColumn("row", F.monotonically_increasing_id()), "signed")
    classes = scratch.save(
        signed.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("doc_id").alias("min_id"), F.min(F.struct("row", "text_hash")).alias("first"))
        .select("set_a", "set_b", "n_shingles", "min_id", "first.row", "first.text_hash")
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    heads = scratch.save(
        signed.filter("n_shingles >= 3").select("row", "sig")
        .join(classes.select("row", "node", "n_shingles", "text_hash"), "row")
        .select("node", "n_shingles", "text_hash", "sig"), "heads")
    bands = heads.select("node", "sig").mapInArrow(_bands, "bucket long, node long")
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = scratch.save(bands.join(shared, "bucket"), "members")

    wanted = scratch.save(heads.join(members.select("node").distinct(), "node"), "wanted")
    scratch.drop(heads)
    texts = (source.filter("text is not null").select("text_hash", "text")
             .join(wanted.select("text_hash", "node"), "text_hash")
             .groupBy("node").agg(F.min("text").alias("text")))
    texts = scratch.save(texts, "texts")
    sigs = wanted.select("node", "n_shingles", "sig")

    labels = tested = None
    for pivots_per_bucket in PIVOTS:
        active = scratch.save(_open(members, labels), "active")
        if active.isEmpty():
            break
        turn = F.xxhash64("node", F.lit(pivots_per_bucket))
        pivots = scratch.save(
            active.groupBy("bucket", F.pmod(turn, F.lit(pivots_per_bucket)).alias("slot"))
            .agg(F.min(F.struct(turn.alias("h"), "node", "comp")).alias("p"))
            .select("bucket", F.col("p.node").alias("pivot"), F.col("p.comp").alias("pivot_comp")), "pivots")
        pairs = _ordered_pairs(active.join(pivots, "bucket").filter("comp <> pivot_comp"))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        tested = pairs = scratch.save(pairs, "pairs")
        a, b = (sigs.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"),
                            F.col("sig").alias(f"sig_{x}")) for x in "ab")
        near = (pairs.join(a, "a").join(b, "b")
                .filter(f"100 * least(n_a, n_b) >= {threshold_pct} * greatest(n_a, n_b)")
                .select("a", "b", "sig_a", "sig_b")
                .mapInArrow(_prune(threshold_pct, miss), "a long, b long"))
        near = scratch.save(near, "near")
        left, right = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        links = scratch.save(
            near.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
            .mapInArrow(_verify(threshold_pct), "a long, b long"), "links")
        labels = _merge(labels, links, scratch)
        # A pivot has met every other component of its bucket: it needs no more partners there.
        members = (active.select("bucket", "node")
                   .join(pivots.select("bucket", F.col("pivot").alias("node")), ["bucket", "node"], "left_anti"))
    else:
        left = scratch.save(_open(members, labels), "active")
        if not left.isEmpty():
            sized = left.join(texts.select("node", F.octet_length("text").alias("bytes")), "node")
            parts = sized.groupBy("bucket").agg(F.greatest(
                F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("parts"))
            dealt = (left.join(parts, "bucket")
                     .withColumn("slot", F.pmod(F.xxhash64("node", F.lit(0)), F.col("parts")).cast("int"))
                     .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                     .select("bucket", "node", "comp", "slot", F.least("slot", "other").alias("one"),
                             F.greatest("slot", "other").alias("two")))
            full = dealt.join(wanted.select("node", "sig").join(texts, "node"), "node")
            links = scratch.save(full.groupBy("bucket", "one", "two")
                                 .applyInArrow(_blocks(threshold_pct, miss), "a long, b long"), "links")
            labels = _merge(labels, links, scratch)

    named = classes.select("set_a", "set_b", "n_shingles", "node", "min_id")
    if labels is not None:
        named = named.join(labels, "node", "left").withColumn("comp", F.coalesce("root", "node"))
        least = named.groupBy("comp").agg(F.min("min_id").alias("component_id"))
        named = named.join(least, "comp")
    else:
        named = named.withColumn("component_id", F.col("min_id")).withColumn("comp", F.col("node"))
    named = named.select("set_a", "set_b", F.col("n_shingles").alias("n"), "component_id", "comp")
    rows = signed.select("doc_id", "text_hash", "n_shingles", "set_a", "set_b")
    out = rows.join(named, (rows.set_a == named.set_a) & (rows.set_b == named.set_b) & (rows.n_shingles == named.n),
                    "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return (out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), "comp")
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, whatever its ids: of its least id (null last), then text hash.

    A text without shingles is a component of its own with its id; of rows that
    repeat an id and a text the first by the other columns stays.
    """
    with arrow_batches(docs.sparkSession, ARROW_ROWS):
        found = _near_duplicates(docs, id_col, text_col, THRESHOLD_PCT, MISS_PROBABILITY)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    alone = found.filter("comp IS NULL").select("doc_id", "text_hash").distinct()
    least = found.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(row).alias("row"))
    kept = least.select("row.doc_id", "row.text_hash").unionByName(alone)
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    # The row as a struct, so that its columns may have any names.
    of = lambda c: F.col("row").getField(c)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("id", of(id_col).cast("long")).withColumn("hash", F.xxhash64(of(text_col)))
    rest = [of(f.name) if isinstance(f.dataType, T.AtomicType) else F.to_json(F.struct(of(f.name)))
            for f in docs.schema if f.name not in (id_col, text_col)]
    turn = F.row_number().over(Window.partitionBy("id", "hash").orderBy(*(rest or ["id"])))
    return (rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi")
            .withColumn("turn", turn).filter("turn = 1")
            .select(*[of(c).alias(c) for c in docs.columns]))
