"""Ranked search against scores of all documents, and what its blocks skip."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlake.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=lexical.K):
    """(item place, rank, doc_id, score)."""
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counted]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    df = collections.Counter(t for _, c in counted for t in c)
    rows = []
    for q, text in enumerate(items):
        scores = []
        for place, ((i, c), n) in enumerate(zip(counted, lengths)):
            score = 0
            for t in set(terms(text)) & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + 50 * n * n_docs // total
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, place, i))
        rows += [(q, r + 1, s[4], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return rows


def corpus(seed, n, vocabulary=300):
    """Texts of a few topics, with common words, copies and odd texts."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        topic = rng.randrange(6)
        words = [f"T{topic}x{int(rng.random() ** 2 * vocabulary)}" if rng.random() < 0.6 else f"c{int(rng.random() ** 3 * 40)}"
                 for _ in range(rng.randrange(3, 80))]
        texts.append(" ".join(words) if rng.random() < 0.9 or not texts else rng.choice(texts))
    return texts + [None, "", " ,.; ", "Ünï 日本-語 a_b\x00c", "x" * 5000, "c1 " * 5000]


@pytest.fixture()
def make_items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("shard, in_task", [(4096, 1 << 20), (40, 1 << 20), (40, 0)])
def test_rank_equals_brute_force(make_docs, make_items, shard, in_task, monkeypatch):
    monkeypatch.setattr(lexical, "GROUP", 7)
    texts = corpus(3, 250)
    rng = random.Random(4)
    items = [" ".join(rng.choice([t for t in texts if t]).split()[:12]) for _ in range(20)] + \
        [None, "", "unknownterm", "C1 c1 c2", "語 ünï A", "x" * 5000]
    docs = make_docs(texts).withColumn("row", F.lit(1)).withColumn("terms", F.lit("t")).withColumn("item_id", F.lit(1))
    got = lexical.rank(docs, make_items(list(enumerate(items))), shard=shard, terms_in_task=in_task).collect()
    assert sorted(map(tuple, got)) == sorted(brute(list(enumerate(texts)), items))


def test_ties_repeats_null_ids_and_few_hits(make_docs, make_items):
    rows = [(9, "same words here"), (2, "same words here"), (2, "same words here"), (None, "same words here"), (4, "other")]
    got = lexical.rank(make_docs([(i, t, "s") for i, t in rows]), make_items([(1, "words same"), (1, "words same")])).collect()
    one = [(r, i, s) for _, r, i, s in brute(rows, ["words same"])]
    assert sorted((r.rank, r.doc_id or -1, r.score) for r in got) == sorted([(r, i or -1, s) for r, i, s in one] * 2)
    assert [i for _, i, _ in one] == [2, 2, 9, None]


def test_empty_tables(make_docs, make_items):
    items = make_items([(1, "a")])
    assert lexical.rank(make_docs(["x"]).limit(0), items).collect() == []
    assert lexical.rank(make_docs(["x"]), items.limit(0)).collect() == []
    assert lexical.rank(make_docs([None, "", "!"]), items).collect() == []


def shard_of(seed, n=3000, vocabulary=2000, topics=100):
    """Documents near one of many topics, as arrays."""
    rng = np.random.default_rng(seed)
    topic = [rng.choice(vocabulary, 25, replace=False) for _ in range(topics)]
    rows = [np.unique(np.append(rng.choice(topic[rng.integers(topics)], 20, replace=False), rng.integers(0, vocabulary, 10)))
            for _ in range(n)]
    indptr = np.cumsum([0, *map(len, rows)])
    impacts = rng.choice([330_000, 500_000, 600_000], indptr[-1], p=[0.8, 0.15, 0.05]) + rng.integers(0, 20_000, indptr[-1])
    weights = rng.integers(1, 9000, vocabulary)
    items = [np.unique(rng.choice(rows[i], 12)) for i in range(20)]
    return np.arange(n), np.zeros(n, bool), np.arange(n), indptr, np.concatenate(rows), impacts, weights, items


def test_bounds_hold_and_blocks_are_skipped():
    arrays = shard_of(1)
    shard = lexical.Shard(*arrays, block=16)
    indptr, terms_, impacts, weights, items = arrays[3:]
    shares = []
    for item in items:
        own = np.zeros_like(weights)
        own[item] = weights[item]
        scores = np.add.reduceat(own[terms_] * impacts, indptr[:-1])
        for t in item:
            x = shard.lists[t]
            assert sorted(x.members) == sorted(np.flatnonzero([t in terms_[a:b] for a, b in zip(indptr[:-1], indptr[1:])]))
            for bound, lo, hi in zip(x.bounds(own), x.starts[:-1], x.starts[1:]):
                assert bound >= scores[x.members[lo:hi]].max()
        best = np.lexsort((np.arange(scores.size), -scores))[:5]
        docs, found, met = shard.search(item, 5, 0)
        assert docs.tolist() == best.tolist() and found.tolist() == scores[best].tolist()
        shares.append(met / (scores > 0).sum())
        floor = int(found[-1])
        assert shard.search(item, 5, floor)[0].tolist() == best.tolist()
        assert shard.search(item, 5, floor + 1)[0].tolist() == best[scores[best] > floor].tolist()
    assert np.mean(shares) < 0.5
