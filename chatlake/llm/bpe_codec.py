"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of all words of a batch lie in one flat array.  In each round every
adjacent pair inside a word is looked up by binary search over the sorted pair
keys; each word then merges its lowest-ranked pair, at all places from left to
right, and the array is packed.  Words whose pairs are all unknown drop out, so
the rounds touch less and less.

Normalisation and pre-tokenisation are the vocabulary file's own, run once for
each distinct run of non-space characters (no rule of the file reaches across
ASCII white space).  Special strings inside texts become their own ids, as the
library treats them by default.

Defined results: a null text is empty; an empty text has no tokens and decodes
to nothing; very long texts are encoded whole; repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.words import Texts, fingerprints, text_slices

SLICE = 1 << 22
#: Runs remembered by a worker; the memory is emptied when full.
CACHE = 500_000


#: Runs whose normal form and pre-tokens need no table: printable ASCII but the apostrophe, and Latin-1 letters.
_PLAIN = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PLAIN_UNITS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256, 257, ... in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A word-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.library = Tokenizer.from_file(path)
        self.letters = byte_letters()
        end = model.get("end_of_word_suffix") or ""
        self.inner, self.final = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
        for letter, b in self.letters.items():
            self.inner[b], self.final[b] = vocab[letter], vocab[letter + end]
        self.size = max(vocab.values()) + 1
        merged = lambda a, b: vocab[a.removesuffix(end) + b if end else a + b]
        pairs = np.array([[vocab[a], vocab[b], merged(a, b)] for a, b in model["merges"]], dtype=np.int64)
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        self.ranks = np.argsort(keys, kind="stable")
        self.keys, self.made = keys[self.ranks], pairs[self.ranks, 2]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        names = {v: k for k, v in vocab.items()} | {v: k for k, v in self.special.items()}
        self.pieces = [names.get(i, "") for i in range(max(names) + 1)]
        self.known: dict[str, bytes] = {}

    def units(self, run: str) -> list[bytes]:
        """The pre-tokens, as bytes, of a run of non-space characters."""
        if _PLAIN.fullmatch(run):
            return [u.encode() for u in _PLAIN_UNITS.findall(run.lower())]
        normal = self.library.normalizer.normalize_str(run)
        return [bytes([self.letters[c] for c in p]) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each pre-token."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[data[ends]]
        word, place = np.repeat(np.arange(len(words)), lengths), np.arange(symbols.size)
        none = np.iinfo(np.int64).max
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while symbols.size:
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            found = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(found, self.ranks[at], none), none)
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(begin, symbols.size))
            lowest = np.minimum.reduceat(rank, begin)
            live = np.repeat(lowest < none, size)
            done.append((word[~live], symbols[~live], place[~live]))
            hit = (rank == np.repeat(lowest, size)) & live
            # Of hits in a row (the same symbol repeated) every second one, from the left, is taken.
            index = np.arange(hit.size)
            head = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), index, 0))
            take = np.flatnonzero(hit & ((index - head) % 2 == 0))
            symbols[take] = self.made[at[take]]
            stay = live
            stay[take + 1] = False
            symbols, word, place = symbols[stay], word[stay], place[stay]
        word, symbol, place = (np.concatenate(x) for x in zip(*done))
        ids = symbol[np.argsort(place, kind="stable")].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def learn(self, runs: list[str]) -> None:
        """Encode runs that are not remembered, all in one batch."""
        parts = [self.units(r) for r in runs]
        distinct = list({p: None for x in parts for p in x})
        ids = dict(zip(distinct, self.merge(distinct))) if distinct else {}
        for run, x in zip(runs, parts):
            self.known[run] = ids[x[0]] if len(x) == 1 else b"".join([ids[p] for p in x])

    def lookup(self, runs: list[str]) -> list[bytes]:
        """Ids of each run, from the memory if possible."""
        if len(self.known) > CACHE:
            self.known.clear()
        new = [r for r in runs if r not in self.known]
        if new:
            self.learn(list(dict.fromkeys(new)))
        return [self.known[r] for r in runs]

    def encode(self, texts: Texts) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each text of the slice."""
        starts, ends, bounds = texts.words()
        words = fingerprints(texts.data, starts, ends)
        _, first, which = np.unique(words, return_index=True, return_inverse=True)
        raw = texts.data.tobytes()
        ids = self.lookup([raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())])
        lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        size = lengths[which]
        stop = np.cumsum(size)
        begin = (np.cumsum(lengths) - lengths)[which]
        out = flat[np.repeat(begin - (stop - size), size) + np.arange(int(size.sum()))].tobytes()
        at = (4 * np.append(0, stop)[bounds]).tolist()
        result = [out[a:b] for a, b in zip(at, at[1:])]
        if self.specials and self.specials.search(raw.decode()):
            for i in range(texts.n):
                if self.specials.search(text := texts.text(i)):
                    result[i] = self.encode_special(text)
        return result

    def encode_special(self, text: str) -> bytes:
        """Ids of a text that holds special strings: those are ids of their own."""
        parts = self.specials.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else b"".join(self.lookup(split(p)))
                        for p in parts)

    def decode(self, ids: bytes) -> str:
        """The file names no decoder: the library joins the pieces with a space."""
        return " ".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_OTHER_SPACES = str.maketrans("\t\n\x0b\x0c\r", "     ")


def split(text: str) -> list[str]:
    """Runs between spaces and ``\\x09-\\x0D``."""
    return [r for r in text.translate(_OTHER_SPACES).split(" ") if r]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _run(path: str, text: str, keep: list[str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        try:
            for batch in batches:
                count, ids, digest, decoded = [], [], [], []
                row = batch["row"]
                for texts in text_slices(row.field(text), SLICE):
                    for x in coder.encode(texts):
                        count.append(len(x) // 4)
                        digest.append(hashlib.sha256(x).hexdigest())
                        decoded.append(hashlib.sha256(coder.decode(x).encode()).hexdigest())
                        if with_ids:
                            ids.append(np.frombuffer(x, dtype="<i4"))
                kept = pa.StructArray.from_arrays([row.field(c) for c in keep], names=keep)
                arrays = [kept, pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
                names = ["row", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        finally:  # workers are used again: by other stages too, which need the memory
            coder.known.clear()
    return run


def encode_and_decode(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None,
                      with_ids: bool = False) -> DataFrame:
    """``row`` (the columns ``keep``), n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids."""
    keep = keep or docs.columns
    fields = [T.StructField("row", T.StructType([docs.schema[c] for c in keep])),
              T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return docs.select(F.struct("*").alias("row")).mapInArrow(_run(path, text_col, keep, with_ids), T.StructType(fields))
