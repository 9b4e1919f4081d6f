"""Token alignment against a brute-force version over each text's bytes."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chatlake.llm import alignment

PATHS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
         public_tokenizers.path("piece_bpe_32k.model"))
ODD = [None, "", " ", "   ", "\n\n", "a", "é ü\x0bx", "日本語 テスト 👩‍👩‍👧", "x" * 3000, "the the " * 300,
       "a\x1cb \x85 c\xa0d", "can't WE'LL 12 3!!", "<|endoftext|>x<s> </s><unk>", "tab\tand\r\nline", "▁x ▁", "<0x41>",
       "a\x00b", "ﬁ ① Å", "a", "the the " * 300, "".join(random.Random(5).choice("abcdeé日 ") for _ in range(4000))]


def byte_table() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(texts):
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    letters = byte_table()
    two = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    docs, counts = [], collections.Counter()
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        b_bytes = [piece(i) for i in b]
        if not text or any(b"".join(x) != (" " + text).encode() for x in (a_bytes, b_bytes)):
            docs.append(None)
            continue
        a_of, b_of = ([k for k, x in enumerate(side) for _ in x] for side in (a_bytes, b_bytes))
        links = sorted(set(zip(a_of, b_of)))
        counts.update((a[x], b[y]) for x, y in links)
        ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (a_bytes, b_bytes)]
        cuts = sorted(ends[0] & ends[1])
        parts = []
        for side, ids in ((a_bytes, a), (b_bytes, b)):
            groups, at, g = [[] for _ in cuts], 0, 0
            for i, x in zip(ids, side):
                at += len(x)
                groups[g].append(i)
                g += at == cuts[g]
            parts.append(groups)
        docs.append((a, b, links, parts))
    top = collections.Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    rows = []
    for d in docs:
        if d is None:
            rows.append((0, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, (ga, gb) = d
        pairs = [(a[x], b[y]) for x, y in links]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(ga, gb))
        rows.append((len(a), len(b), len(ga), len(links), sum(counts[p] == top[p[1]] for p in pairs),
                     sum(counts[p] for p in pairs), sum(len(x) * len(y) for x, y in zip(ga, gb)),
                     hashlib.sha256(text.encode()).hexdigest()))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_shared", "groups_sha256"]


@pytest.mark.parametrize("slice_bytes, block_bytes", [(1 << 19, 32 << 20), (50, 400)])
def test_align_equals_brute_force(make_docs, slice_bytes, block_bytes):
    rng = random.Random(1)
    alphabet = "etaoin shrdlu  ETA,.'1 9\n\té日😀"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(60)]
    docs = make_docs(texts).withColumn("block", F.lit(1)).withColumn("pairs", F.lit("x"))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, *PATHS, slice_bytes=slice_bytes, block_bytes=block_bytes).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_blocks_and_slices_do_not_matter():
    both = alignment.tokenizers(*PATHS)
    whole = alignment.Aligned(both, [x or "" for x in ODD])
    listing, at = whole.listing()
    for i, x in enumerate(ODD):
        alone, _ = alignment.Aligned(both, [x or ""]).listing()
        assert listing[at[i]:at[i + 1]] == alone


def test_row_products_equal_dense():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x, y = (rng.integers(0, 4, shape) == 0 for shape in ((9, 7), (7, 8)))
        a, b = (alignment.Csr(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], m.shape[1]) for m in (x, y))
        dense = np.zeros((9, 8), dtype=int)
        for rows, cols, values in alignment.row_products(a, b, products=5):
            dense[rows, cols] += values
        assert (dense == x.astype(int) @ y.astype(int)).all()
        assert [(r, c) for r in range(7) for c in np.flatnonzero(x.T[r])] == \
            [(r, c) for r in range(7) for c in a.transposed().indices[a.transposed().indptr[r]:a.transposed().indptr[r + 1]]]


def test_packed_numbers_come_back():
    for x in ([], [0], [5, 5 + (1 << 33), 1 << 39], list(range(1000))):
        assert alignment._unpack(alignment._pack(np.array(x, dtype=np.int64))).tolist() == x


def test_links_are_the_overlaps(make_docs):
    rows = alignment.links(make_docs([(7, "unbelievable é", "s"), (8, None, "s"), (None, "ab", "s")]), *PATHS).collect()
    assert {r.doc_id for r in rows} == {7, None}
    assert sum(r.n_bytes for r in rows if r.doc_id == 7) == len(" unbelievable é".encode())
    assert all(r.group_from <= r.b_place < r.group_to for r in rows)


def test_empty_table_and_repeated_rows(make_docs):
    assert alignment.align(make_docs(["x"]).limit(0), *PATHS).count() == 0
    docs = make_docs([(1, "same text", "s"), (1, "same text", "s"), (None, "same text", "s")])
    rows = alignment.align(docs, *PATHS).collect()
    assert len(rows) == 3 and len({(r.n_links, r.count_sum, r.groups_sha256) for r in rows}) == 1


def test_long_texts(make_docs):
    """A megabyte without white space, and one of words."""
    texts = ["ab" * 300_000, "word " * 100_000]
    rows = {r.doc_id: r for r in alignment.align(make_docs(texts), *PATHS).collect()}
    assert rows[0].n_links >= rows[0].n_a > 0 and rows[1].n_links >= 100_000
