"""Quality rules: tokeniser fertility with rejection bands, beside plain counts.

One pass in numpy gives each document its counts (words, symbols, repeated lines
and eight-word windows) and how a public vocabulary takes it: characters per
token, the share of byte-fallback tokens and the entropy of its tokens in bits.
A slice's distinct words are encoded once each.

The bands come from the documents themselves: within a language and a size
class (power of two of the token count), a value further than ``SPREAD``
interquartile ranges outside the quartiles is rejected.  Quartiles are read off
exact histograms of rounded values, so they cover all rows, do not depend on
partitions, and need a table bounded by languages, classes and bins.  A group of
fewer than ``LEAST_GROUP`` documents takes in the language's nearest size classes
until it has as many, in a language of fewer documents those of all languages,
and in a smaller table all documents: every text with a word is judged.

Defined results: a null text has no words and fails the base rule; a null
language is a group of its own; repeated rows count separately; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.shared import Scratch
from chatlake.llm.words import BEGINS, IS_SPACE, Texts, fingerprints, mix, per_text, spread, text_slices

MIN_WORDS = 20
MAX_REPEAT_PCT = 30
WINDOW = 8
SYMBOLS = np.zeros(256, dtype=np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1

SLICE = 1 << 22
BINS = 50
SPREAD = 3.0
#: Least interquartile range of each measure, so that narrow groups keep ordinary documents.
LEAST_RANGE = {"chars_per_token": 0.12, "fallback_share": 0.02, "token_entropy": 0.25}
LEAST_GROUP = 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = list(LEAST_RANGE)

_rng = np.random.Generator(np.random.PCG64(8))
_WEIGHTS = _rng.integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _model(path: str):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def repeated_words(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each text inside an eight-word window that occurs in it more than once."""
    n = max(0, words.size - WINDOW + 1)
    if not n:
        return np.zeros(bounds.size - 1, dtype=np.int64)
    doc = spread(bounds)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(WINDOW):
        key += words[j:j + n] * _WEIGHTS[j]
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1:])
    key = mix(key[inside]) ^ mix(doc[inside].astype(np.uint64) + np.uint64(0x51ED27))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(inside.size, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(words.size + 1, dtype=np.int64)
    at = inside[twice]
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return per_text((np.cumsum(change)[:-1] > 0).astype(np.int64), bounds)


def duplicate_lines(texts: Texts, starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    breaks = np.flatnonzero(texts.data == 10)
    begin = np.unique(np.concatenate([texts.offs[:-1], breaks + 1]))
    begin = begin[begin < texts.data.size]
    doc = np.searchsorted(texts.offs, begin, "right") - 1
    after = np.concatenate([breaks, [texts.data.size]])
    end = np.minimum(after[np.searchsorted(breaks, begin)], texts.offs[doc + 1])
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    doc = doc[worded]
    line = fingerprints(texts.data, begin[worded], end[worded])
    order = np.lexsort((line, doc))
    same = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][same], minlength=texts.n)


def fertility(texts: Texts, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, bounds: np.ndarray,
              path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, byte-fallback tokens and token entropy (bits) of each text."""
    model, is_byte = _model(path)
    _, first, which = np.unique(words, return_index=True, return_inverse=True)
    raw = texts.data.tobytes()
    ids = model.encode([raw[s:e].decode() for s, e in zip(starts[first].tolist(), ends[first].tolist())],
                       num_threads=1)
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int64, count=int(lengths.sum()))
    begin = np.cumsum(lengths) - lengths
    fallback = per_text(np.add.reduceat(np.append(is_byte[flat], 0).astype(np.int64), begin)[which]
                        if begin.size else np.zeros(0, np.int64), bounds)
    size = lengths[which]
    tokens = per_text(size, bounds)
    # All token ids of the slice, text by text.
    at = np.repeat(begin[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    key = np.repeat(spread(bounds), size) * len(is_byte) + flat[at]
    seen, count = np.unique(key, return_counts=True)
    total = np.bincount(seen // len(is_byte), weights=count * np.log2(count), minlength=texts.n)
    some = np.maximum(tokens, 1)
    return tokens, fallback, np.log2(some) - total / some


def _measure(path: str, text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[str, list[np.ndarray]] = {c: [] for c in [*COUNTS, "n_tokens", *MEASURES]}
            row = batch["row"]
            for texts in text_slices(row.field(text), SLICE):
                starts, ends, bounds = texts.words()
                words = fingerprints(texts.data, starts, ends)
                tokens, fallback, entropy = fertility(texts, starts, ends, words, bounds, path)
                at = np.concatenate([[0], np.cumsum(BEGINS[texts.data] & ~IS_SPACE[texts.data])])[texts.offs]
                symbols = np.concatenate([[0], np.cumsum(SYMBOLS[texts.data])])[texts.offs]
                chars, some = np.diff(at), np.maximum(tokens, 1)
                found = [np.diff(bounds), chars, np.diff(symbols), duplicate_lines(texts, starts),
                         repeated_words(words, bounds), tokens, chars / some, fallback / some, entropy]
                for c, values in zip(parts, found):
                    parts[c].append(values)
            kept = pa.StructArray.from_arrays([row.field(c) for c in keep], names=keep)
            whole = [pa.array(np.concatenate(v or [np.zeros(0)])) for v in parts.values()]
            whole = [v.cast(pa.float64() if c in MEASURES else pa.int64()) for c, v in zip(parts, whole)]
            yield pa.RecordBatch.from_arrays([kept, *whole], names=["row", *parts])
    return run


def measure(docs: DataFrame, text_col: str, path: str, keep: list[str]) -> DataFrame:
    """``row`` (the columns ``keep``), the base counts, n_tokens and the three measures."""
    fields = [T.StructField("row", T.StructType([docs.schema[c] for c in keep]))]
    fields += [T.StructField(c, T.LongType()) for c in [*COUNTS, "n_tokens"]]
    fields += [T.StructField(c, T.DoubleType()) for c in MEASURES]
    return docs.select(F.struct("*").alias("row")).mapInArrow(_measure(path, text_col, keep), T.StructType(fields))


def _reach(sizes: DataFrame, by: list[str]) -> DataFrame:
    """``reach`` (null if none) and ``far``: classes on either side that hold LEAST_GROUP documents, and that there are."""
    other = sizes.select(*[F.col(c).alias(f"o_{c}") for c in [*by, "class", "n"]])
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"o_{c}"))
    steps = (sizes.join(other, same).groupBy(*by, "class", F.abs(F.col("class") - F.col("o_class")).alias("step"))
             .agg(F.sum("o_n").alias("n")))
    up_to = Window.partitionBy(*by, "class").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return (steps.withColumn("up_to", F.sum("n").over(up_to)).groupBy(*by, "class")
            .agg(F.min(F.when(F.col("up_to") >= LEAST_GROUP, F.col("step"))).alias("reach"), F.max("step").alias("far")))


def _widened(bins: DataFrame, reach: DataFrame, by: list[str]) -> DataFrame:
    """The histograms of each class with those of the classes in its reach."""
    other = bins.select(*[F.col(c).alias(f"o_{c}") for c in [*by, "class"]], "measure", "bin", "k")
    near = F.abs(F.col("class") - F.col("o_class")) <= F.col("reach")
    for c in by:
        near = near & (F.col(c) == F.col(f"o_{c}"))
    return reach.join(other, near).groupBy(*by, "class", "measure", "bin").agg(F.sum("k").alias("k"))


def _limits(bins: DataFrame, by: list[str]) -> DataFrame:
    """Lower and upper limits of each measure from the histograms of ``by``."""
    all_of = Window.partitionBy(*by, "measure")
    up_to = all_of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    marked = bins.withColumn("below", F.sum("k").over(up_to)).withColumn("n", F.sum("k").over(all_of))
    at = lambda q: F.min(F.when(F.col("below") >= F.col("n") * q, F.col("bin"))) / BINS
    least = F.element_at(F.create_map(*[x for m, v in LEAST_RANGE.items() for x in (F.lit(m), F.lit(v))]), F.col("measure"))
    edges = (marked.groupBy(*by, "measure")
             .agg(at(0.25).alias("q1"), (at(0.75) + 1 / BINS).alias("q3"))
             .withColumn("range", F.greatest(F.col("q3") - F.col("q1"), least)))
    low, high = F.col("q1") - SPREAD * F.col("range"), F.col("q3") + SPREAD * F.col("range")
    pick = lambda m, x: F.max(F.when(F.col("measure") == m, x))
    return edges.groupBy(*by).agg(
        *[pick(m, low).alias(f"{m}_low") for m in MEASURES], *[pick(m, high).alias(f"{m}_high") for m in MEASURES])


def bands(measured: DataFrame, lang: str, scratch: Scratch) -> DataFrame:
    """Lower and upper limits by language and size class, from exact histograms."""
    worded = measured.filter("n_words > 0")
    group = [_lang(lang).alias("lang"), size_class().alias("class")]
    values = F.explode(F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.col(m))])).alias("measure", "value")
    bins = scratch.save(worded.select(*group, values)
                        .groupBy("lang", "class", "measure", F.floor(F.col("value") * BINS).alias("bin"))
                        .agg(F.count("*").alias("k")), "bins")
    sizes = bins.filter(F.col("measure") == MEASURES[0]).groupBy("lang", "class").agg(F.sum("k").alias("n"))
    reach = scratch.save(_reach(sizes, ["lang"]), "reach")
    own = _limits(_widened(bins, reach.filter("reach IS NOT NULL"), ["lang"]), ["lang", "class"])
    # Languages of too few documents: the size classes of all languages.
    reach_all = _reach(sizes.groupBy("class").agg(F.sum("n").alias("n")), [])
    reach_all = reach_all.withColumn("reach", F.coalesce("reach", "far"))
    shared = bins.groupBy("class", "measure", "bin").agg(F.sum("k").alias("k"))
    common = _limits(_widened(shared, reach_all, []), ["class"])
    return own.unionByName(reach.filter("reach IS NULL").select("lang", "class").join(common, "class"))


def _lang(column: str) -> Column:
    """A row's language as a key that is never null: a null language is not the empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"row.{column}")), F.lit(""))


def size_class():
    return F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))).cast("int")


def judge(docs: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang",
          keep: list[str] | None = None) -> DataFrame:
    """``row``, the counts and measures, base_failed, in_bands and kept of every document."""
    keep = list(dict.fromkeys([*(keep or docs.columns), lang_col]))
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.save(measure(docs, text_col, path, keep), "measured")
    limits = scratch.save(bands(measured, lang_col, scratch), "bands")
    limits = limits.withColumnsRenamed({"lang": "b_lang", "class": "b_class"})
    joined = measured.join(limits, (_lang(lang_col) == F.col("b_lang"))
                           & (size_class() == F.col("b_class")), "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return (joined.withColumn("base_failed", failed).withColumn("in_bands", inside)
            .withColumn("kept", ~F.col("base_failed") & F.col("in_bands"))
            .select("row", *COUNTS, "n_tokens", *MEASURES, "base_failed", "in_bands", "kept"))
