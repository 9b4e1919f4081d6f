"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token starts as a linked list of byte symbols.  A heap holds its known
adjacent pairs by rank and place; the lowest is popped, and if both symbols are
still there they become one and their new neighbours' pairs are pushed.  The
count is the initial symbols minus the merges; no identifiers are emitted.

A text is cut before each white-space run that follows a non-space character.
No pre-token reaches across such a cut, so a slice's distinct units are counted
once and remembered (a bounded memory for each worker).

Defined results: a null or empty text has no bytes and no tokens; the special
string of the vocabulary, inside a text, is one token; texts with white space
beyond ASCII are pre-tokenised whole; repeated rows repeat.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chatlake.llm.bpe_codec import byte_letters
from chatlake.llm.words import Texts, fingerprints, per_text, text_slices

SLICE = 1 << 22
#: Units, and pre-tokens, remembered by a worker; a full memory is emptied.
MEMORY = 400_000
LIMIT = 512

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[\t-\r !-&(-~{_LETTER}]*")
_PLAIN_TOKENS = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+")
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class TokenCounter:
    """Counts the tokens that a byte-level BPE vocabulary file gives."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.pre_tokenize = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.letters = byte_letters()
        self.start = [0] * 256
        for letter, b in self.letters.items():
            self.start[b] = vocab[letter]
        self.width = max(vocab.values()) + 1
        self.pairs, self.made = [], []
        for a, b in spec["model"]["merges"]:
            self.pairs.append(vocab[a] * self.width + vocab[b])
            self.made.append(vocab[a + b])
        self.rank = {p: r for r, p in enumerate(self.pairs)}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.units: dict[bytes, int] = {}
        self.tokens: dict[str, int] = {}

    def merge(self, token: bytes) -> int:
        """Initial symbols minus merges of one pre-token."""
        n = left = len(token)
        if n < 2:
            return n
        width, rank, pairs = self.width, self.rank, self.pairs
        symbol = [self.start[b] for b in token]
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(symbol[i] * width + symbol[i + 1])
            if r is not None:
                heap.append(r * n + i)
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if symbol[i] < 0 or j < 0 or symbol[i] * width + symbol[j] != pairs[r]:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = self.made[r], -1
            left -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                r = rank.get(symbol[i] * width + symbol[k])
                if r is not None:
                    heappush(heap, r * n + i)
            h = before[i]
            if h >= 0:
                r = rank.get(symbol[h] * width + symbol[i])
                if r is not None:
                    heappush(heap, r * n + h)
        return left

    def token(self, token: str) -> int:
        """Count of a pre-token in plain characters."""
        n = self.tokens.get(token)
        if n is None:
            if len(self.tokens) >= MEMORY:
                self.tokens.clear()
            n = self.tokens[token] = self.merge(token.encode())
        return n

    def unit(self, text: str) -> int:
        """Count of a text that is pre-tokenised as a whole."""
        if _PLAIN.fullmatch(text):
            return sum(map(self.token, _PLAIN_TOKENS.findall(text)))
        letters = self.letters
        return sum(self.merge(bytes([letters[c] for c in p])) for p, _ in self.pre_tokenize(text))

    def whole(self, text: str) -> int:
        """Count of a text with special strings or unusual white space."""
        parts = self.special.split(text) if self.special else [text]
        return sum(map(self.unit, parts)) + len(parts) - 1

    def count(self, texts: Texts) -> np.ndarray:
        """Tokens of each text of the slice."""
        starts, ends, bounds = texts.words()
        first = np.zeros(starts.size, dtype=bool)
        filled = bounds[:-1] < bounds[1:]
        first[bounds[:-1][filled]] = True
        begin = np.append(0, ends[:-1])[:starts.size]
        begin[first] = texts.offs[:-1][filled]
        # White space after the last word, or a text of nothing else, is a unit of its own.
        tail = np.where(filled, np.append(0, ends)[bounds[1:]], texts.offs[:-1])
        open_ = np.flatnonzero(tail < texts.offs[1:])
        raw = texts.data.tobytes()
        _, one, which = np.unique(fingerprints(texts.data, begin, ends), return_index=True, return_inverse=True)
        counts = np.array([self.known(raw[a:b]) for a, b in zip(begin[one].tolist(), ends[one].tolist())],
                          dtype=np.int64)
        total = per_text(counts[which] if counts.size else np.zeros(0, dtype=np.int64), bounds)
        for i in open_.tolist():
            total[i] += self.known(raw[tail[i]:texts.offs[i + 1]])
        text = raw.decode()
        if _WIDE_SPACE.search(text) or self.special and self.special.search(text):
            for i in range(texts.n):
                text = texts.text(i)
                if _WIDE_SPACE.search(text) or self.special and self.special.search(text):
                    total[i] = self.whole(text)
        return total

    def known(self, unit: bytes) -> int:
        n = self.units.get(unit)
        if n is None:
            if len(self.units) >= MEMORY:
                self.units.clear()
            n = self.units[unit] = self.unit(unit.decode())
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def _run(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in batches:
            n, size = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for texts in text_slices(batch["text"], SLICE):
                n.append(tokens.count(texts))
                size.append(np.diff(texts.offs))
            n, size = np.concatenate(n), np.concatenate(size)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(size), pa.array(n), pa.array(n > limit)],
                                             names=["id", "n_bytes", "n_tokens", "over_limit"])
    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        _run(path, limit), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
