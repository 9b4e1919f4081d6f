"""Word splitting and 64-bit fingerprints over Arrow batches of texts, in numpy.

A word is a run of bytes other than space and ``\\x09-\\x0D``; UTF-8 never uses
those values inside a character, so bytes and code points split alike.  Texts
are handled in slices of a few MB (one text, if longer), so the memory of a
task does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
BLOCK_BYTES = 1 << 18

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that begin a UTF-8 character.
BEGINS = (np.arange(256) & 0xC0) != 0x80

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each ``data[start:end]``: a polynomial modulo 2**64, mixed.

    Computed over blocks of bytes from prefix sums, so it costs the same for
    many short or few long words.
    """
    out = np.empty(starts.size, dtype=np.uint64)
    i = 0
    while i < starts.size:
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK_BYTES, "right")))
        hi = int(ends[j - 1])
        up, down = _powers(BLOCK_BYTES) if hi - lo <= BLOCK_BYTES else _powers(hi - lo)
        prefix = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:hi - lo], out=prefix[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (prefix[e] - prefix[s]) * down[s] ^ (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


class Texts:
    """A slice of consecutive texts as bytes: ``data``, and ``offs`` of each text's begin."""

    def __init__(self, first: int, data: np.ndarray, offs: np.ndarray) -> None:
        self.first, self.data, self.offs = first, data, offs
        self.n = offs.size - 1

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and ``bounds``: text i has words bounds[i]:bounds[i + 1]."""
        data = self.data if data is None else data
        solid = ~IS_SPACE[data]
        edge = np.zeros(data.size + 1, dtype=bool)
        edge[self.offs] = True
        first, last = solid.copy(), solid.copy()
        if data.size:
            first[1:] &= ~solid[:-1] | edge[1:-1]
            last[:-1] &= ~solid[1:] | edge[1:-1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.offs)

    def text(self, i: int) -> str:
        return self.data[self.offs[i]:self.offs[i + 1]].tobytes().decode()


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow string column in slices of at most ``limit`` bytes (null: empty)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield Texts(i, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
        i = j


def spread(bounds: np.ndarray) -> np.ndarray:
    """Index of the text of each word."""
    return np.repeat(np.arange(bounds.size - 1), np.diff(bounds))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the words' values by text."""
    n = bounds.size - 1
    if values.dtype.kind == "f":  # summed text by text, so that rounding doesn't depend on the slice
        return np.bincount(spread(bounds), weights=values, minlength=n)
    total = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]
