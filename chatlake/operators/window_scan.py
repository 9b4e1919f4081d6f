"""Anchored windows over range partitions: window state as a composable step function.

Within a key, the state before an event is (start of the current window, events
counted in it).  A range partition of sorted events maps the state that it is
entered with to the state that it is left with, and the map is a step function
of the carried start alone: a start s either covers the whole partition, or the
first event after s + W opens a window, and all that follows depends on which
event that is.  Only a partition of a single key depends on its entry at all;
one that holds a second key is a constant.

Step functions compose, so the state at every partition's entry comes from a
scan: neighbours are composed in groups of ``FAN`` level by level, the top group
is evaluated from an empty state, and the states go back down the same levels.
A task holds the functions of one group, each bounded by a partition's events
within one window length; the driver gets one small row for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Functions composed in one task.
FAN = 16
#: Stands for "no window" as an entry, and for "the carried start stays" as an exit.
NONE = np.iinfo(np.int64).min

Key = tuple[int, int]


@dataclass
class Steps:
    """From the entry (key, start, count) of a segment to its exit.

    Step i holds for starts from ``lo[i]`` on, up to the next step.  It leaves with
    (start[i], count[i]), or keeps the carried start and adds count[i] where start[i] is NONE.
    """

    first: Key
    last: Key
    lo: np.ndarray
    start: np.ndarray
    count: np.ndarray

    def leave(self, key: Key | None, start: int, count: int, most: int) -> tuple[Key, int, int]:
        carried = start if key == self.first else NONE
        i = int(np.searchsorted(self.lo, carried, "right")) - 1
        if self.start[i] == NONE:
            return self.last, carried, min(most, count + int(self.count[i]))
        return self.last, int(self.start[i]), int(self.count[i])

    def then(self, after: Steps, most: int) -> Steps:
        """The segment's function followed by the next segment's."""
        same = self.last == after.first
        lo, start, count = [], [], []
        for i in range(self.lo.size):
            if self.start[i] != NONE:
                _, s, c = after.leave(self.last, int(self.start[i]), int(self.count[i]), most)
                pieces = [(int(self.lo[i]), s, c)]
            elif not same:
                _, s, c = after.leave(None, NONE, 0, most)
                pieces = [(int(self.lo[i]), s, c)]
            else:  # the carried start goes on: all steps of the next segment in this interval
                stop = int(self.lo[i + 1]) if i + 1 < self.lo.size else None
                a = int(np.searchsorted(after.lo, self.lo[i], "right")) - 1
                b = after.lo.size if stop is None else int(np.searchsorted(after.lo, stop, "left"))
                pieces = [(max(int(self.lo[i]), int(after.lo[j])), int(after.start[j]),
                           min(most, int(after.count[j]) + (int(self.count[i]) if after.start[j] == NONE else 0)))
                          for j in range(a, b)]
            for piece in pieces:
                if not start or (start[-1], count[-1]) != piece[1:]:
                    lo.append(piece[0])
                    start.append(piece[1])
                    count.append(piece[2])
        return Steps(self.first, after.last, *(np.array(x, dtype=np.int64) for x in (lo, start, count)))


def steps_of(key: Key, t: np.ndarray, window: int, most: int) -> Steps:
    """Of sorted events of one key."""
    n = t.size
    after = np.searchsorted(t, t + window, "right")
    place = np.arange(n)
    # The last window that a chain of windows beginning at each event reaches.
    last = np.where(after < n, np.minimum(after, n - 1), place)
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    # An entry's start is not after the first event, so it reaches no further than its window's end.
    reach = int(np.searchsorted(t, t[0] + window, "right"))
    opens = np.flatnonzero(np.append(True, t[1:reach] != t[:max(0, reach - 1)]))[: reach]
    if reach < n and (reach == 0 or t[reach] != t[reach - 1]):
        opens = np.append(opens, reach)
    lo = np.where(opens == 0, NONE, t[np.maximum(opens, 1) - 1] - window)
    start, count = t[last[opens]], np.minimum(most, n - last[opens])
    if reach == n:  # starts that cover everything
        lo, start, count = np.append(lo, t[-1] - window), np.append(start, NONE), np.append(count, min(most, n))
    keep = np.append(True, (start[1:] != start[:-1]) | (count[1:] != count[:-1]))
    return Steps(key, key, lo[keep], start[keep], count[keep])


def constant(first: Key, last: Key, start: int, count: int) -> Steps:
    one = lambda x: np.array([x], dtype=np.int64)
    return Steps(first, last, one(NONE), one(start), one(count))


# ---------------------------------------------------------------- as rows

STEPS_DDL = ("segment long, first_a long, first_b long, last_a long, last_b long, lo array<long>, start array<long>, "
             "count array<long>")
ENTRY_DDL = "segment long, a long, b long, start long, count long"
_NAMES = ["segment", "first_a", "first_b", "last_a", "last_b", "lo", "start", "count"]


def row_of(segment: int, f: Steps) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x], pa.int64()) for x in (segment, *f.first, *f.last)]
        + [pa.array([x], pa.list_(pa.int64())) for x in (f.lo, f.start, f.count)], names=_NAMES)


def functions_of(table: pa.Table) -> list[tuple[int, Steps]]:
    """(segment, function) in the order of segments."""
    table = table.sort_by("segment")
    keys = zip(*(table[c].to_pylist() for c in _NAMES[:5]))
    lists = [[x.values.to_numpy(zero_copy_only=False) for x in table[c]] for c in _NAMES[5:]]
    return [(s, Steps((fa, fb), (la, lb), *arrays)) for (s, fa, fb, la, lb), arrays in zip(keys, zip(*lists))]


# ---------------------------------------------------------------- scan

@dataclass
class _Walk:
    """States at the entries of consecutive segments, from the state before the first."""

    most: int
    rows: list[tuple] = field(default_factory=list)

    def through(self, functions: list[tuple[int, Steps]], state: tuple[Key | None, int, int]) -> list[tuple]:
        for segment, f in functions:
            if state[0] == f.first:
                self.rows.append((segment, *state[0], *state[1:]))
            state = f.leave(*state, self.most)
        return self.rows


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["segment", "a", "b", "start", "count"])


def _compose(most: int):
    def run(table: pa.Table) -> pa.Table:
        functions = functions_of(table)
        whole = functions[0][1]
        for _, f in functions[1:]:
            whole = whole.then(f, most)
        return pa.Table.from_batches([row_of(functions[0][0] // FAN, whole)])
    return run


def _descend(most: int):
    """Entries of a group's segments from the entry of the group (none: entered with another key)."""
    def run(table: pa.Table, entry: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([])
        state = (None, NONE, 0)
        if entry.num_rows:
            a, b, s, c = (entry[x][0].as_py() for x in ("a", "b", "start", "count"))
            state = ((a, b), s, c)
        return _table(_Walk(most).through(functions_of(table), state))
    return run


def entries(functions: DataFrame, segments: int, most: int) -> dict[int, tuple[Key, int, int]]:
    """State at the entry of each segment that goes on with the key before it.

    ``functions`` has a row (STEPS_DDL) for each non-empty one of ``segments`` segments.
    """
    group = F.floor(F.col("segment") / FAN).cast("long")
    levels = [functions]
    while segments > FAN:
        levels.append(levels[-1].groupBy(group.alias("group")).applyInArrow(_compose(most), STEPS_DDL)
                      .checkpoint(eager=True))
        segments = -(-segments // FAN)
    found = None
    for level in reversed(levels):
        if found is None:
            found = level.groupBy(group.alias("group")).applyInArrow(
                lambda table: _table(_Walk(most).through(functions_of(table), (None, NONE, 0))), ENTRY_DDL)
        else:
            found = (level.groupBy(group.alias("group")).cogroup(found.groupBy("segment"))
                     .applyInArrow(_descend(most), ENTRY_DDL))
    return {r["segment"]: ((r["a"], r["b"]), r["start"], r["count"]) for r in found.collect()}


def summarise(window: int, most: int, digest: tuple[str, str], time: str, segment: str, state: str | None = None):
    """A partition's sorted events to one row with its step function.

    Events of the first key are held (8 bytes each) until a second key comes; of later keys only the state.
    Rows where the column ``state`` is set are not events: they begin a key with a window start and this count.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chatlake.operators.limits import fold_windows
        number = first = last = None
        held: list[np.ndarray] | None = []      # None: the state does not depend on the entry
        start, count = None, 0
        for batch in batches:
            if not len(batch):
                continue
            a, b, t = (batch[c].to_numpy() for c in (*digest, time))
            given = batch[state].fill_null(-1).to_numpy() if state else np.full(len(batch), -1)
            number = batch[segment][0].as_py()
            bounds = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            for lo, hi in zip(bounds.tolist(), [*bounds[1:].tolist(), len(batch)]):
                key = (int(a[lo]), int(b[lo]))
                if key != last:
                    if first is not None:
                        held = None
                    first, last, start, count = first or key, key, None, 0
                if given[lo] >= 0:
                    held, start, count, lo = None, int(t[lo]), int(given[lo]), lo + 1
                if held is not None:
                    held.append(t[lo:hi].copy())
                else:
                    start, count = fold_windows(t[lo:hi], start, count, window, most, np.zeros(hi - lo, dtype=bool))
        if number is not None:
            yield row_of(number, constant(first, last, start, count) if held is None
                         else steps_of(first, np.concatenate(held), window, most))
    return run
