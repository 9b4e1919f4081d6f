"""Ranked lexical search with per-term geometric blocking.

Scores are sums over an item's terms of integer weight x impact, the impact of a
term in a document saturating with its occurrences and falling with the
document's length.  Documents are dealt into shards and items into groups; each
pair of a shard and a group is one task.  In it, every term's posting list is
clustered by document similarity: about one in BLOCK of its documents are
pivots, and each document joins the pivot nearest to it (by random projections
of the weighted impact vectors).  A cluster is a *block*, with the
coordinatewise maximum of its documents' impacts as its summary, over the terms
that share an item with the list's.  A summary's weighted sum for an item is an
exact upper bound of every score in the block.  An item takes the blocks of its
terms in order of their bounds, scores the documents it has not met, and skips
the rest once the best bound left is below its kth score; a bound that equals it
is no reason to skip, as ties go by id.

A first wave over a sixteenth of the shards gives each item a kth score that
all other shards begin with.  Counts of documents, terms and lengths cover the
whole table.

Defined results: a null text, document or item, has no terms; an item without
terms in any document has no rows; documents with equal scores rank by id (null
last), and repeated rows are documents each, ranked one after the other; items
that repeat an id or a text are ranked each on their own; an empty table gives
no rows; other columns are ignored, whatever their names.  Terms are compared by
64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.shared import Scratch
from chatlake.llm.words import LOWER, Texts, fingerprints, mix, text_slices

K = 50
#: Documents in a shard, items in a group, and documents that a block holds on average.
SHARD, GROUP, BLOCK = 4096, 256, 16
#: Up to so many terms of items go to every task (8 bytes each), to keep only their
#: postings; with more, all postings are written and joined with the terms.
TERMS_IN_TASK = 1 << 20
#: Every so many shards one is searched in the first wave.
FIRST_WAVE = 16
SKETCH = 32
#: Impacts are below 2 ** 20: 10 ** 9 * tf // (1000 * tf + 20 * m) < 10 ** 6.
IMPACT_BITS = 20

#: Bytes of terms: ASCII letters and digits and all of other characters.
IN_TERM = np.zeros(256, dtype=bool)
IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


# ---------------------------------------------------------------- terms

def terms_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all terms of a slice, and ``bounds``: text i has terms bounds[i]:bounds[i + 1]."""
    data = LOWER[texts.data]
    solid = IN_TERM[data]
    edge = np.zeros(data.size + 1, dtype=bool)
    edge[texts.offs] = True
    before, after = np.append(False, solid)[:data.size], np.append(solid, False)[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return fingerprints(data, starts, ends), np.searchsorted(starts, texts.offs)


def _count_terms(wanted: np.ndarray | None):
    """(id, n, terms, tf) of each text: its distinct terms, of ``wanted`` if that is given (sorted)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch["text"]):
                prints, bounds = terms_of(texts)
                text = np.repeat(np.arange(texts.n), np.diff(bounds))
                if wanted is not None:
                    at = np.minimum(np.searchsorted(wanted, prints), max(0, wanted.size - 1))
                    held = wanted[at] == prints if wanted.size else np.zeros(prints.size, dtype=bool)
                    prints, text = prints[held], text[held]
                order = np.lexsort((prints, text))
                prints, text = prints[order], text[order]
                head = np.flatnonzero(np.append(text.size > 0, (text[1:] != text[:-1]) | (prints[1:] != prints[:-1])))
                tf = np.diff(np.append(head, text.size))
                offsets = pa.array(np.searchsorted(text[head], np.arange(texts.n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(texts.first, texts.n), pa.array(np.diff(bounds), pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(prints[head].view(np.int64))),
                     pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))],
                    names=["id", "n", "terms", "tf"])
    return run


COUNTED = "id long, n long, terms array<long>, tf array<long>"


# ---------------------------------------------------------------- index of a shard

def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), first[1], ..."""
    skip = np.repeat(first - (np.cumsum(size) - size), size)
    return skip + np.arange(skip.size)


class List:
    """One term's posting list, cut into blocks with summaries."""

    def __init__(self, members: np.ndarray, starts: np.ndarray, s_terms: np.ndarray, s_most: np.ndarray,
                 s_starts: np.ndarray) -> None:
        self.members, self.starts = members, np.append(starts, members.size)
        self.s_terms, self.s_most, self.s_starts = s_terms, s_most, s_starts

    def bounds(self, weights: np.ndarray) -> np.ndarray:
        """Upper bound of the scores in each block (every summary holds the list's own term)."""
        return np.add.reduceat(weights[self.s_terms] * self.s_most, self.s_starts)


class Shard:
    """Documents of a shard as rows of impacts, and the blocked lists of the terms of a group of items."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, rows: np.ndarray, indptr: np.ndarray, terms: np.ndarray,
                 impacts: np.ndarray, weights: np.ndarray, items: list[np.ndarray], block: int = BLOCK) -> None:
        """``terms`` number ``weights``; ``items`` are the items' terms."""
        self.ids, self.no_id, self.rows = ids, no_id, rows
        self.indptr, self.terms, self.impacts, self.weights = indptr, terms.astype(np.int32), impacts, weights
        self.size = np.diff(indptr)
        together: list[list[np.ndarray]] = [[] for _ in range(weights.size)]
        for x in items:
            for t in x.tolist():
                together[t].append(x)
        doc_of = np.repeat(np.arange(ids.size), self.size)
        by_term = np.argsort(terms, kind="stable")
        stops = np.searchsorted(terms[by_term], np.arange(weights.size + 1))
        sketch = self._sketch()
        wanted = np.zeros(weights.size, dtype=bool)
        self.lists: list[List | None] = []
        for t in range(weights.size):
            docs = doc_of[by_term[stops[t]:stops[t + 1]]]
            if not docs.size or not together[t]:
                self.lists.append(None)
                continue
            for x in together[t]:
                wanted[x] = True
            self.lists.append(self._blocked(docs, sketch, wanted, block))
            for x in together[t]:
                wanted[x] = False

    def _sketch(self) -> np.ndarray:
        """Random projections of the documents' weighted vectors, of length 1."""
        bits = mix(np.arange(self.weights.size, dtype=np.uint64) + np.uint64(0x2545F4914F6CDD1D))
        sign = ((bits[:, None] >> np.arange(SKETCH, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1
        out = np.zeros((self.ids.size, SKETCH), dtype=np.float32)
        value = (self.impacts * self.weights[self.terms]).astype(np.float32)
        for lo in range(0, self.ids.size, 256):
            part = slice(self.indptr[lo], self.indptr[min(lo + 256, self.ids.size)])
            full = np.flatnonzero(self.size[lo:lo + 256])
            if full.size:
                out[lo + full] = np.add.reduceat(value[part, None] * sign[self.terms[part]],
                                                 self.indptr[lo + full] - self.indptr[lo], axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)

    def _blocked(self, docs: np.ndarray, sketch: np.ndarray, wanted: np.ndarray, block: int) -> List:
        n = -(-docs.size // block)
        own = np.zeros(docs.size, dtype=np.int64)
        if n > 1:
            pivots = docs[np.arange(n) * docs.size // n]
            own = np.argmax(sketch[docs] @ sketch[pivots].T, axis=1)
            order = np.argsort(own, kind="stable")
            docs, own = docs[order], own[order]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        own = np.repeat(np.arange(starts.size), np.diff(np.append(starts, docs.size)))
        at = _ranges(self.indptr[docs], self.size[docs])
        own = np.repeat(own, self.size[docs])
        use = wanted[self.terms[at]]
        at, own = at[use], own[use]
        key = np.sort(((own * wanted.size + self.terms[at]) << IMPACT_BITS) | self.impacts[at])
        cell = key >> IMPACT_BITS
        last = np.flatnonzero(np.append(cell[1:] != cell[:-1], True))  # the largest impact of each (block, term)
        s_block, s_terms = np.divmod(cell[last], wanted.size)
        return List(docs, starts, s_terms, key[last] & ((1 << IMPACT_BITS) - 1),
                    np.searchsorted(s_block, np.arange(starts.size)))

    def search(self, item: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, documents met): the k best above 0 and not below ``floor``, best first."""
        weights = np.zeros_like(self.weights)
        weights[item] = self.weights[item]
        lists = [self.lists[t] for t in item.tolist() if self.lists[t] is not None]
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        bounds = np.concatenate([x.bounds(weights) for x in lists])
        of = np.repeat(np.arange(len(lists)), [x.starts.size - 1 for x in lists])
        place = np.concatenate([np.arange(x.starts.size - 1) for x in lists])
        order = np.argsort(-bounds, kind="stable")
        met = np.zeros(self.ids.size, dtype=bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor, done, step = max(floor, 1), 0, 4
        while done < order.size and bounds[order[done]] >= floor:
            part = order[done:done + step]
            part = part[bounds[part] >= floor]
            done, step = done + step, 2 * step
            new = np.unique(np.concatenate([lists[l].members[lists[l].starts[b]:lists[l].starts[b + 1]]
                                            for l, b in zip(of[part].tolist(), place[part].tolist())]))
            new = new[~met[new]]
            if not new.size:
                continue
            met[new] = True
            at = _ranges(self.indptr[new], self.size[new])
            sums = np.add.reduceat(weights[self.terms[at]] * self.impacts[at],
                                   np.cumsum(self.size[new]) - self.size[new])
            good = sums >= floor
            docs, scores = np.concatenate([docs, new[good]]), np.concatenate([scores, sums[good]])
            best = np.lexsort((self.rows[docs], self.ids[docs], self.no_id[docs], -scores))[:k]
            docs, scores = docs[best], scores[best]
            if docs.size == k:
                floor = max(floor, int(scores[-1]))
        return docs, scores, int(met.sum())


# ---------------------------------------------------------------- search

def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of a column of lists."""
    joined = column.combine_chunks()
    joined = joined.combine_chunks() if isinstance(joined, pa.ChunkedArray) else joined
    return joined.flatten().to_numpy(), np.concatenate([[0], np.cumsum(joined.value_lengths().to_numpy())]).astype(np.int64)


FOUND = "item long, item_id long, doc_id long, row long, score long"


def _search(k: int):
    def run(docs: pa.Table, items: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if docs.num_rows and items.num_rows:
            asked, q_bounds = _lists(items["terms"])
            weights, _ = _lists(items["weights"])
            names, first, number = np.unique(asked, return_index=True, return_inverse=True)
            prints, bounds = _lists(docs["terms"])
            tf, _ = _lists(docs["tf"])
            at = np.minimum(np.searchsorted(names, prints), names.size - 1)
            use = names[at] == prints
            doc_of = np.repeat(np.arange(docs.num_rows), np.diff(bounds))[use]
            tf, m = tf[use], docs["m"].to_numpy()
            impacts = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc_of])
            asked_of = [number[a:b] for a, b in zip(q_bounds[:-1], q_bounds[1:])]
            ids = docs["doc_id"]
            shard = Shard(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), docs["row"].to_numpy(),
                          np.searchsorted(doc_of, np.arange(docs.num_rows + 1)), at[use], impacts, weights[first],
                          asked_of)
            floors = items["floor"].to_numpy()
            for i, item in enumerate(asked_of):
                place, scores, _ = shard.search(item, k, int(floors[i]))
                found.append((np.full(place.size, i), place, scores))
        item, place, score = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        item, place = pa.array(item, pa.int64()), pa.array(place, pa.int64())
        return pa.table([items["item"].take(item), items["item_id"].take(item), docs["doc_id"].take(place),
                         docs["row"].take(place), pa.array(score, pa.int64())],
                        names=["item", "item_id", "doc_id", "row", "score"])
    return run


def rank(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
         item_id_col: str = "item_id", item_text_col: str = "text", shard: int = SHARD,
         terms_in_task: int = TERMS_IN_TASK) -> DataFrame:
    """item_id, rank, doc_id and score: each item's ``k`` best documents."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    as_input = lambda df, i, t: df.select(F.col(i).cast("long").alias("id"), F.col(t).alias("text"))
    asked = scratch.save(as_input(items, item_id_col, item_text_col).mapInArrow(_count_terms(None), COUNTED)
                         .filter("n > 0").withColumn("item", F.monotonically_increasing_id()), "items")
    wanted = scratch.save(asked.select(F.explode("terms").alias("term")).distinct(), "wanted")
    source = as_input(docs, id_col, text_col)
    if wanted.count() <= terms_in_task:
        prints = np.sort(wanted.toArrow()["term"].to_numpy().view(np.uint64))
        counted = source.mapInArrow(_count_terms(prints), COUNTED)
    else:
        counted = _joined(scratch.save(source.mapInArrow(_count_terms(None), COUNTED)
                                       .withColumn("row", F.monotonically_increasing_id()), "counted"), wanted)
    if "row" not in counted.columns:
        counted = counted.withColumn("row", F.monotonically_increasing_id())
    counted = scratch.save(counted, "postings")

    total = counted.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    if not total.docs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * total.docs + 2) / (2 * F.col("df") + 1)))
    weights = df.select("term", weight.alias("weight"))
    of_item = (asked.select("item", F.col("id").alias("item_id"), F.explode("terms").alias("term")).join(weights, "term")
               .groupBy("item", "item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")))
    of_item = scratch.save(of_item, "weighted")

    held = counted.filter(F.size("terms") > 0)
    n_shards = max(1, -(-held.count() // shard))
    n_groups = max(1, -(-of_item.count() // GROUP))
    first = -(-n_shards // FIRST_WAVE)
    # 50 * n * N first, as the definition divides once.
    m = F.expr(f"50 + (50 * n * {total.docs}L) div {total.length}L")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    shards = held.select("row", F.col("id").alias("doc_id"), m.alias("m"), "terms", "tf", deal("row", n_shards).alias("shard"),
                         F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group"))

    def wave(shards_from: int, shards_to: int, items_with_floor: DataFrame) -> DataFrame:
        numbers = F.explode(F.sequence(F.lit(shards_from), F.lit(shards_to - 1)))
        right = items_with_floor.withColumn("group", deal("item", n_groups)).withColumn("shard", numbers)
        part = shards.filter(F.col("shard").between(shards_from, shards_to - 1))
        return part.groupBy("shard", "group").cogroup(right.groupBy("shard", "group")).applyInArrow(_search(k), FOUND)

    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found = scratch.save(wave(0, first, of_item.withColumn("floor", F.lit(0).cast("long"))), "found")
    if first < n_shards:
        floors = ranked(found).filter(F.col("rank") == k).select("item", F.col("score").alias("floor"))
        with_floor = of_item.join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0).cast("long")))
        found = found.union(wave(first, n_shards, with_floor))
    return ranked(found).select("item_id", "rank", "doc_id", "score")


def _joined(counted: DataFrame, wanted: DataFrame) -> DataFrame:
    """The counted texts with their wanted terms only, by a join of all postings."""
    pairs = counted.select("row", F.explode(F.arrays_zip("terms", "tf")).alias("p")).select("row", "p.terms", "p.tf")
    kept = (pairs.join(wanted.withColumnRenamed("term", "terms"), "terms")
            .groupBy("row").agg(F.collect_list(F.struct("terms", "tf")).alias("p")))
    none = F.array().cast("array<long>")
    return (counted.select("id", "n", "row").join(kept, "row", "left")
            .select("id", "n", F.coalesce(F.col("p.terms"), none).alias("terms"),
                    F.coalesce(F.col("p.tf"), none).alias("tf"), "row"))
