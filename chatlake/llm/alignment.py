"""Token alignment of two tokenizers by products of token-byte incidence matrices.

A text's tokens under either tokenizer cut the same bytes, so each tokenizer is
an incidence matrix of tokens x bytes, held as hand-built CSR arrays.  The rows
of A·Bᵀ, built one after the other from the rows of Bᵀ that a row of A names
(Gustavson's algorithm, in numpy over blocks of rows), are the *overlap links*:
pairs of token occurrences with the number of bytes they share.  Bytes at which
tokens of both end cut the text into groups; the product of the token-group
incidences gives the *shared-group links*.  A token lies in one group, so a row
of that product is one row of the group's matrix and is kept as a range of B
tokens, however large the group.

Corpus counts of id pairs need every document twice, before and after the sum.
A task's documents form blocks.  A block numbers its distinct pairs and keeps a
document as a sparse row of (pair number, times); only a block's distinct pairs
are shuffled, summed and sent back, and each document's figures are row sums
over them.  A pair that every document holds is one row of each block.

Defined results: a text that is null, empty, or whose tokens' bytes differ from
space + text has no tokens (all figures 0, digest ``''``); strings of special
tokens are plain text; rows that repeat an id or a text are documents of their
own; a null id is kept; an empty table gives no rows; columns other than the id
and the text are ignored, whatever their names.  A text is held whole in one task,
with about 100 bytes for each of its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.shared import Scratch, arrow_batches

#: Bytes of text aligned at once (one text, if longer), and products in a block of rows.
SLICE_BYTES = 1 << 19
PRODUCTS = 1 << 20
#: Bytes of text in a block of documents that share one numbering of pairs.
BLOCK_BYTES = 32 << 20
#: Rows of an Arrow batch: a batch of texts lies in memory several times.
ARROW_ROWS = 1000
#: An id pair (A id x size of B's vocabulary + B id) fits so many bits.
PAIR_BITS = 40


# ---------------------------------------------------------------- sparse matrices

class Csr:
    """A matrix of 0 and 1: row i has columns ``indices[indptr[i]:indptr[i + 1]]``."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, n_cols: int) -> None:
        self.indptr, self.indices, self.n_cols = indptr, indices, n_cols

    @property
    def n_rows(self) -> int:
        return self.indptr.size - 1

    def transposed(self) -> Csr:
        """By counting: the entries of each column, rows ascending."""
        counts = np.bincount(self.indices, minlength=self.n_cols)
        rows = np.repeat(np.arange(self.n_rows), np.diff(self.indptr))
        if self.indices.size and (self.indices[1:] < self.indices[:-1]).any():
            rows = rows[np.argsort(self.indices, kind="stable")]
        return Csr(np.concatenate([[0], np.cumsum(counts)]), rows, self.n_rows)


def row_products(a: Csr, b: Csr, products: int = PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, values) of the matrix product a·b, by blocks of rows of ``a``.

    Row i of the product is the sum of the rows of ``b`` that row i of ``a`` names.  A block
    expands at most ``products`` terms, or one row's.
    """
    size = np.diff(b.indptr)
    terms = np.concatenate([[0], np.cumsum(size[a.indices])])[a.indptr]
    lo = 0
    while lo < a.n_rows:
        hi = max(lo + 1, int(np.searchsorted(terms, terms[lo] + products, "right")) - 1)
        named = a.indices[a.indptr[lo]:a.indptr[hi]]
        row = np.repeat(np.arange(lo, hi), np.diff(a.indptr[lo:hi + 1]))
        n = size[named]
        row, first = np.repeat(row, n), np.repeat(b.indptr[named] - (np.cumsum(n) - n), n)
        col = b.indices[first + np.arange(row.size)]
        key = row * b.n_cols + col
        if key.size and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            row, col, key = row[order], col[order], key[order]
        head = np.flatnonzero(np.append(key.size > 0, key[1:] != key[:-1]))
        yield row[head], col[head], np.diff(np.append(head, key.size))
        lo = hi


# ---------------------------------------------------------------- tokenizers

class Tokenizers:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, ranks_path: str, pattern: str, pieces_path: str) -> None:
        import sentencepiece
        import tiktoken
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        self.b_bytes = [bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
                        for i in range(self.b.vocab_size()) for piece in [self.b.id_to_piece(i)]]
        self.a_size, self.b_size = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text under both; none for texts whose bytes are not kept."""
        one = [self.a.encode_ordinary(" " + x) if x else [] for x in texts]
        two = [[] if not x else ids for x, ids in zip(texts, self.b.encode(texts, num_threads=1))] if texts else []
        for i, x in enumerate(texts):
            want = (" " + x).encode() if x else b""
            if any(b"".join([table[t] for t in ids]) != want
                   for table, ids in ((self.a_bytes, one[i]), (self.b_bytes, two[i]))):
                one[i], two[i] = [], []
        return one, two


@lru_cache(maxsize=1)
def tokenizers(ranks_path: str, pattern: str, pieces_path: str) -> Tokenizers:
    return Tokenizers(ranks_path, pattern, pieces_path)


# ---------------------------------------------------------------- alignment

def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.cumsum([0, *map(len, lists)])
    return np.concatenate([np.zeros(0, np.int64), *(np.array(ids, np.int64) for ids in lists if ids)]), bounds


class Aligned:
    """Tokens of several texts: ids, incidences, groups and links."""

    def __init__(self, both: Tokenizers, texts: list[str]) -> None:
        one, two = both.encode(texts)
        (self.a, self.a_bounds), (self.b, self.b_bounds) = _flat(one), _flat(two)
        a_ends, b_ends = np.cumsum(both.a_size[self.a]), np.cumsum(both.b_size[self.b])
        n_bytes = int(a_ends[-1]) if a_ends.size else 0
        by_byte = lambda ends: Csr(np.concatenate([[0], ends]), np.arange(n_bytes), n_bytes)
        self.a_incidence, self.b_incidence = by_byte(a_ends), by_byte(b_ends)
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        self.n_groups_all = cuts.size
        by_group = lambda ends: Csr(np.arange(ends.size + 1), np.searchsorted(cuts, ends), cuts.size)
        self.a_groups, self.b_groups = by_group(a_ends), by_group(b_ends)

    def overlap_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A occurrences, B occurrences, shared bytes) in blocks."""
        return row_products(self.a_incidence, self.b_incidence.transposed())

    def shared_group_links(self) -> tuple[np.ndarray, np.ndarray]:
        """Each A occurrence's range of B occurrences in its group: the rows of the product of the group incidences."""
        members = self.b_groups.transposed().indptr
        return members[self.a_groups.indices], members[self.a_groups.indices + 1]

    def n_groups(self) -> np.ndarray:
        """Groups of each text: no group spans two."""
        first = np.append(self.a_groups.indices, self.n_groups_all)[self.a_bounds]
        return np.diff(first)

    def listing(self) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` of all texts in a row, and where each begins."""
        a_first, b_first = (np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.n_cols))])
                            for m in (self.a_groups, self.b_groups))
        ids = np.empty(self.a.size + self.b.size, dtype=np.int64)
        after = np.full(ids.size, ord(","), dtype=np.uint8)
        ids[np.arange(self.a.size) + b_first[self.a_groups.indices]] = self.a
        ids[np.arange(self.b.size) + a_first[self.b_groups.indices + 1]] = self.b
        after[a_first[1:] + b_first[:-1] - 1] = ord("|")
        after[a_first[1:] + b_first[1:] - 1] = ord(";")
        digits = np.ones(ids.size, dtype=np.int64)
        for power in range(1, 10):
            digits += ids >= 10 ** power
        ends = np.cumsum(digits + 1)
        out = np.empty(int(ends[-1]) if ids.size else 0, dtype=np.uint8)
        out[ends - 1] = after
        rest, left = ids, np.arange(ids.size)
        place = ends - 2
        while left.size:
            out[place] = ord("0") + rest % 10
            more = rest >= 10
            rest, place, left = rest[more] // 10, place[more] - 1, left[more]
        at = np.concatenate([[0], ends])[self.a_bounds + self.b_bounds]
        return out.tobytes(), at


def _slices(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    first, held, size = 0, [], 0
    for i, x in enumerate(texts):
        x = x or ""
        if held and size + 4 * len(x) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(x)
        size += 4 * len(x)
    if held:
        yield first, held


def _pack(numbers: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences."""
    raw = np.diff(numbers, prepend=0).astype("<i8")
    small = raw.astype("<u4")
    wide = bool((small != raw).any())
    data = (raw if wide else small).tobytes()
    return (b"w" if wide else b"s") + numbers.size.to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n, wide = int.from_bytes(data[1:9], "little"), data[:1] == b"w"
    raw = pa.decompress(data[9:], n * (8 if wide else 4), codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, "<i8" if wide else "<u4").astype(np.int64))


class Block:
    """Documents that share one numbering of id pairs."""

    def __init__(self, number: int) -> None:
        self.number, self.size, self.rows = number, 0, []
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, aligned: Aligned, ids: list[int | None], texts: list[str], n_b_ids: int) -> None:
        n = len(texts)
        doc_of = np.repeat(np.arange(n), np.diff(aligned.a_bounds))
        # One number for each link: its document, then its id pair.
        found = [(doc_of[a] << PAIR_BITS) + aligned.a[a] * n_b_ids + aligned.b[b] for a, b, _ in aligned.overlap_links()]
        key, times = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        doc, pair = key >> PAIR_BITS, key & ((1 << PAIR_BITS) - 1)
        stops = np.searchsorted(doc, np.arange(n + 1))
        links = np.bincount(doc, weights=times, minlength=n).astype(np.int64)
        low, high = aligned.shared_group_links()
        shared = np.bincount(doc_of, weights=high - low, minlength=n).astype(np.int64)
        listing, at = aligned.listing()
        groups = aligned.n_groups()
        for i in range(n):
            text = listing[at[i]:max(at[i], at[i + 1] - 1)]
            lo, hi = stops[i], stops[i + 1]
            self.rows.append((ids[i], int(aligned.a_bounds[i + 1] - aligned.a_bounds[i]),
                              int(aligned.b_bounds[i + 1] - aligned.b_bounds[i]), int(groups[i]), int(links[i]),
                              int(shared[i]), hashlib.sha256(text).hexdigest() if text else "",
                              _pack(pair[lo:hi]), pa.compress(times[lo:hi].astype("<u4").tobytes(), codec="zstd",
                                                              asbytes=True)))
        key, at = np.unique(pair, return_inverse=True)
        self.pairs.append((key, np.bincount(at, weights=times).astype(np.int64)))
        if len(self.pairs) >= 16:
            self.fold()
        self.size += sum(map(len, texts))

    def fold(self) -> None:
        key = np.concatenate([k for k, _ in self.pairs]) if self.pairs else np.zeros(0, np.int64)
        times = np.concatenate([t for _, t in self.pairs]) if self.pairs else np.zeros(0, np.int64)
        key, at = np.unique(key, return_inverse=True)
        self.pairs = [(key, np.bincount(at, weights=times, minlength=key.size).astype(np.int64))]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The documents' rows, then the block's distinct pairs and their counts as one row."""
        self.fold()
        names = BLOCK_SCHEMA.names
        for i in range(0, len(self.rows), ARROW_ROWS):
            part = self.rows[i:i + ARROW_ROWS]
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.number] * len(part), pa.int64()), pa.array([False] * len(part)),
                 *(pa.array(x, t) for x, t in zip(zip(*part), BLOCK_SCHEMA.types[2:]))], names=names)
        key, times = self.pairs[0]
        row = [self.number, True, None, 0, 0, 0, 0, 0, "", _pack(key),
               pa.compress(times.astype("<i8").tobytes(), codec="zstd", asbytes=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, BLOCK_SCHEMA.types)], names=names)


BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("is_pairs", pa.bool_()), ("doc_id", pa.int64()), ("n_a", pa.int64()),
                          ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                          ("n_shared", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()),
                          ("times", pa.binary())])
BLOCK_DDL = ("block long, is_pairs boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, "
             "groups_sha256 string, pairs binary, times binary")


def _align(ranks_path: str, pattern: str, pieces_path: str, slice_bytes: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        both = tokenizers(ranks_path, pattern, pieces_path)
        number = TaskContext.get().partitionId() << 32
        block = Block(number)
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for first, held in _slices(texts, slice_bytes):
                block.add(Aligned(both, held), ids[first:first + len(held)], held, len(both.b_bytes))
                if block.size >= block_bytes:
                    yield from block.batches()
                    number += 1
                    block = Block(number)
        if block.rows:
            yield from block.batches()
    return run


def _spell_out(n_b_ids: int):
    """The pairs of each block as rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pairs, times in zip(*(batch[c].to_pylist() for c in ("block", "pairs", "times"))):
                key = _unpack(pairs)
                n = np.frombuffer(pa.decompress(times, 8 * key.size, codec="zstd", asbytes=True), "<i8")
                for i in range(0, key.size, 1 << 16):
                    part = slice(i, min(key.size, i + (1 << 16)))
                    size = part.stop - i
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, number)), pa.array(key[part]),
                                                      pa.array(n[part])], names=["block", "pair", "n"])
    return run


def _figures(docs: pa.Table, totals: pa.Table) -> pa.Table:
    """Row sums of a block's documents over the corpus figures of its pairs."""
    order = np.argsort(totals["pair"].to_numpy())
    key, total, best = (totals[c].to_numpy()[order] for c in ("pair", "total", "best"))
    n_best, count_sum = [], []
    for pairs, times in zip(docs["pairs"].to_pylist(), docs["times"].to_pylist()):
        own = _unpack(pairs)
        n = np.frombuffer(pa.decompress(times, 4 * own.size, codec="zstd", asbytes=True), "<u4").astype(np.int64)
        at = np.searchsorted(key, own)
        n_best.append(int(n[best[at]].sum()))
        count_sum.append(int((n * total[at]).sum()))
    kept = [docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256")]
    return pa.table([*kept, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "n_best",
                           "count_sum"])


def align(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, id_col: str = "doc_id",
          text_col: str = "text", slice_bytes: int = SLICE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Alignment figures of every row of ``docs``.

    n_a, n_b: tokens; n_groups; n_links: overlap links; n_shared: shared-group links; groups_sha256;
    n_best: links whose id pair is the most frequent of its B id in the corpus; count_sum: the
    links' corpus counts summed.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_b_ids = len(tokenizers(ranks_path, pattern, pieces_path).b_bytes)
    with arrow_batches(spark, ARROW_ROWS):
        blocks = scratch.save(source.mapInArrow(
            _align(ranks_path, pattern, pieces_path, slice_bytes, block_bytes), BLOCK_DDL), "blocks")
    rows = (blocks.filter("is_pairs").select("block", "pairs", "times")
            .mapInArrow(_spell_out(n_b_ids), "block long, pair long, n long"))
    total = F.sum("n").over(Window.partitionBy("pair"))
    totals = scratch.save(rows.select("block", "pair", total.alias("total")), "totals")
    b_id = F.pmod("pair", F.lit(n_b_ids)).cast("int")
    # At most one row for each id of B's vocabulary.
    top = totals.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("top"))
    best = (totals.withColumn("b_id", b_id).join(F.broadcast(top), "b_id")
            .select("block", "pair", "total", (F.col("total") == F.col("top")).alias("best")))
    return (blocks.filter("NOT is_pairs").drop("is_pairs").groupBy("block").cogroup(best.groupBy("block"))
            .applyInArrow(_figures, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, "
                                    "groups_sha256 string, n_best long, count_sum long"))


def links(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row for each overlap link: doc_id, the tokens' places and ids, shared bytes, and the B places of the A token's group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(ranks_path, pattern, pieces_path)
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].to_pylist()
            for first, held in _slices(texts):
                x = Aligned(both, held)
                low, high = x.shared_group_links()
                doc_of = np.repeat(np.arange(len(held)), np.diff(x.a_bounds))
                for a, b, shared in x.overlap_links():
                    doc = doc_of[a]
                    columns = [a - x.a_bounds[doc], x.a[a], b - x.b_bounds[doc], x.b[b], shared,
                               low[a] - x.b_bounds[doc], high[a] - x.b_bounds[doc]]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(first + doc)), *(pa.array(c, pa.int64()) for c in columns)],
                        names=["doc_id", "a_place", "a_id", "b_place", "b_id", "n_bytes", "group_from", "group_to"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, a_place long, a_id long, b_place long, b_id long, n_bytes long, "
                                  "group_from long, group_to long")
