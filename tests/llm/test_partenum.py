"""The PartEnum join against all pairs compared, and its signatures' guarantee."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatlake.llm import partenum, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def shingles(text):
    tokens = WORD.findall((text or "").translate(LOWER))
    if len(tokens) < 3:
        return {tuple(tokens)} if tokens else set()
    return {tuple(tokens[i:i + 3]) for i in range(len(tokens) - 2)}


def brute(rows, pct=90):
    """Component of each row: its least id reachable by links."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and (find(i) not in least or doc_id < least[find(i)]):
            least[find(i)] = doc_id
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def near_copies(rng):
    """Texts with copies of every distance around the threshold, in groups of several sizes."""
    texts = []
    for n in (3, 5, 9, 12, 13, 14, 22, 30, 45, 60, 100, 250):
        base = prose(rng, n)
        texts.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(1, 2 + n // 40)):
                kind, at = rng.randrange(3), rng.randrange(len(copy))
                if kind == 0:
                    copy[at] = f"x{rng.randrange(99)}"
                elif kind == 1:
                    del copy[at]
                else:
                    copy.insert(at, f"y{rng.randrange(99)}")
            texts.append(" ".join(copy))
    return texts


ODD = [None, "", " \n ", "One", "one", "one two", "ONE two", "a b c", "a b c d", "a a a a a", "a " * 3000, "日本 語 é x",
       "日本 語 é X", "a\x0bb\x0cc", "a b c"]


@pytest.mark.parametrize("pivots, block", [((1, 4), 1024), ((), 5)])
def test_components_equal_brute_force(make_docs, pivots, block, monkeypatch):
    rng = random.Random(8)
    texts = ODD + near_copies(rng) + [" ".join(prose(rng, 40, 12)) for _ in range(20)]
    rng.shuffle(texts)
    monkeypatch.setattr(partenum, "PIVOTS", pivots)
    monkeypatch.setattr(partenum, "BLOCK_MEMBERS", block)
    docs = make_docs(texts).withColumn("node", F.lit(1)).withColumn("row", F.lit("r")).withColumn("sig", F.lit(2))
    got = sorted(tuple(r) for r in partenum.jaccard_components(docs).collect())
    assert got == sorted(brute(list(enumerate(texts))))


def test_near_sets_share_a_signature():
    """Whatever the sizes: sets at the threshold, of one band or of two."""
    rng = np.random.default_rng(4)
    for _ in range(400):
        x = int(rng.integers(1, 900))
        most = partenum.difference_bound(x, x, 90)
        pool = np.unique(rng.integers(0, 1 << 64, 3 * x + 50, dtype=np.uint64))
        rng.shuffle(pool)
        gone, more = sorted(rng.integers(0, most + 1, 2))
        one, other = pool[:x], np.concatenate([pool[gone:x], pool[x:x + more - gone]])
        shared = x - gone
        if 100 * shared < 90 * (one.size + other.size - shared) or np.array_equal(np.sort(one), np.sort(other)):
            continue
        a, b = (partenum.signatures(np.sort(s)) for s in (one, other))
        assert np.intersect1d(a, b).size, (x, gone, more)


def test_all_boundary_sizes_have_common_instances():
    for pct in (50, 75, 90, 95):
        ratio = max(partenum.BAND_RATIO, 100 / pct + 0.01)
        for x in range(1, 400):
            for y in {x, min(x + 1, 100 * x // pct), 100 * x // pct}:
                if partenum.difference_bound(x, y, pct) == 0:
                    continue
                common = ({i.number for i in partenum.instances(x, pct, ratio)}
                          & {i.number for i in partenum.instances(y, pct, ratio)})
                assert any(partenum.difference_bound(x, y, pct) <= i.k for i in partenum.instances(x, pct, ratio)
                           if i.number in common), (pct, x, y)


def test_unlike_sets_share_few_signatures():
    rng = np.random.default_rng(5)
    sigs = [partenum.signatures(np.unique(rng.integers(0, 1 << 64, 500, dtype=np.uint64))) for _ in range(200)]
    assert np.unique(np.concatenate(sigs)).size > 0.98 * sum(s.size for s in sigs)


def test_short_texts_and_shingles():
    of = lambda *texts: [s.size for part in words.text_slices(pa.array(texts)) for s in partenum.shingle_sets(part)]
    assert of(None, "", "a", "a b", "a b c", "a b c a b c a b c", "a a a a") == [0, 0, 1, 1, 1, 3, 1]


def test_repeated_rows_null_ids_and_empty(make_docs):
    text = " ".join(prose(random.Random(2), 60))
    rows = [(5, text), (5, text), (None, text), (3, text + " more"), (None, "alone here now"), (None, ""), (7, None)]
    docs = make_docs([(i, t, "s") for i, t in rows])
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in partenum.jaccard_components(docs).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    assert partenum.jaccard_components(docs.limit(0)).count() == 0


def test_long_texts(make_docs):
    """Two near copies of 200,000 words."""
    base = prose(random.Random(6), 200_000, 1 << 30)
    other = list(base)
    for i in range(0, len(other), 100):
        other[i] = "changed"
    got = {r.doc_id: r.component_id for r in partenum.jaccard_components(make_docs([" ".join(base), " ".join(other)])).collect()}
    assert got == {0: 0, 1: 0}
