"""Periodic runs of words, from Lyndon roots.

A run is a stretch of words with smallest period ``q`` that no neighbouring word extends. The
longest Lyndon word at some place of every run is a root of it, in one of two orders of the
words, each the reverse of the other. The two arrays of longest Lyndon words come
straight from the first phase of Baier's suffix sorting: suffixes are grouped by their first
word, the groups are taken from the highest down, and the suffixes a group's members point back to
move into groups of their own, whose context is the old one followed by the group's. When all are
taken, a group's context is the longest Lyndon word of its members. Each root is extended
to both sides by longest common extensions, which are looked up in tables that name
all stretches of 1, 2, 4, … words.

Before that, words that cannot be in a run long enough are taken out: in a run of exponent ``e``
every word occurs ``floor(e)`` times, so a word that is rarer within its stretch ends
the stretch. This loses no run and makes none, since a run's neighbours differ either way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.llm.common import arrow_schema, byte_slices, ship
from palaver.llm.wordhash import Words, mixed

ship(__name__)

_SLICE = 1 << 22
RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("collapsed", T.StringType()),
    ]
)


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by grouping (phase one of Baier's sorting)."""
    n = len(symbols)
    of: dict[int, list[int]] = {}
    for i, s in enumerate(symbols):
        of.setdefault(s, []).append(i)
    members = [of[s] for s in sorted(of)]
    context, below, above = [1] * len(members), list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    group = [0] * n
    for g, places in enumerate(members):
        for i in places:
            group[i] = g
    before, taken, out = [-1] * n, bytearray(n), [0] * n
    current = len(members) - 1
    while current >= 0:
        places = [i for i in members[current] if group[i] == current]
        size = context[current]
        targets: list[list[int]] = []  # of each number of pointers, the places they point to
        last, count = -1, 0
        for i in places:
            taken[i] = 1
            out[i] = size
            p = i - 1
            while p >= 0 and taken[p]:
                p = before[p]
            before[i] = p
            if p == last:
                count += 1
                continue
            if last >= 0:
                while len(targets) < count:
                    targets.append([])
                targets[count - 1].append(last)
            last, count = p, 1
        if last >= 0:
            while len(targets) < count:
                targets.append([])
            targets[count - 1].append(last)
        for count in range(len(targets), 0, -1):
            new: dict[int, int] = {}
            for p in targets[count - 1]:
                old = group[p]
                g = new.get(old)
                if g is None:
                    g = new[old] = len(members)
                    members.append([])
                    context.append(context[old] + count * size)
                    high = above[old]  # never missing: the group being taken stands above
                    below.append(old)
                    above.append(high)
                    below[high] = above[old] = g
                members[g].append(p)
                group[p] = g
        members[current] = []
        current = below[current]
    return out


class Extensions:
    """Longest common extensions of any two places, exact: equal stretches of ``2 ** k`` words have equal names."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.n, self.names = len(symbols), [symbols.astype(np.int64)]
        while 2 << (len(self.names) - 1) <= longest:
            k = 1 << (len(self.names) - 1)
            own = self.names[-1]
            pairs = own[:-k] * (int(own.max()) + 1) + own[k:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))

    def _extend(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """How far the words from ``x < y`` on agree, to the right (1) or to the left (-1)."""
        x, y, total = x.copy(), y.copy(), np.zeros(len(x), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            while True:  # a stretch can be there twice only at the longest size
                a, b = (x, y) if step > 0 else (x - size + 1, y - size + 1)
                at = np.flatnonzero((a >= 0) & (b + size <= self.n))
                at = at[names[a[at]] == names[b[at]]]
                x[at] += step * size
                y[at] += step * size
                total[at] += size
                if k < len(self.names) - 1 or not len(at):
                    break
        return total

    def right(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self._extend(x, y, 1)

    def left(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self._extend(x, y, -1)


def find(stretches: list[np.ndarray], least_length: int = 2, least_exponent: float = 2.0) -> np.ndarray:
    """Rows ``stretch, start, length, period`` of the runs of each stretch of word hashes, in that order."""
    stretches = [s for s in stretches]
    if not stretches or not any(len(s) for s in stretches):
        return np.zeros((0, 4), np.int64)
    sizes = np.array([len(s) for s in stretches])
    names = np.unique(np.concatenate(stretches), return_inverse=True)[1].astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    # between two stretches stands a symbol of its own, which nothing extends over
    first = bounds[:-1] + np.arange(len(sizes))
    together = np.empty(bounds[-1] + len(sizes), np.int64)
    ends = first + sizes
    together[ends] = int(names.max()) + 1 + np.arange(len(sizes))
    inside = np.ones(len(together), bool)
    inside[ends] = False
    together[inside] = names
    periods = [np.zeros(len(together), np.int64), np.zeros(len(together), np.int64)]
    for at, a, b in zip(first.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        for order, sign in enumerate((1, -1)):
            periods[order][at : at + b - a] = lyndon_lengths((sign * names[a:b]).tolist())
    starts = np.tile(np.flatnonzero(inside), 2)
    root = np.concatenate([p[inside] for p in periods])
    roots = np.unique(starts * (len(together) + 1) + root)
    starts, root = roots // (len(together) + 1), roots % (len(together) + 1)
    extensions = Extensions(together, int(sizes.max()))
    right = extensions.right(starts, starts + root)
    left = extensions.left(starts - 1, starts + root - 1)
    length = left + root + right
    enough = (length >= 2 * root) & (length >= least_length) & (length >= least_exponent * root)
    starts, length, root = (starts - left)[enough], length[enough], root[enough]
    owner = np.searchsorted(first, starts, "right") - 1
    return np.unique(np.stack([owner, starts - first[owner], length, root], axis=1), axis=0)


def candidates(words: Words, least_length: int, least_exponent: float) -> list[tuple[int, int]]:
    """Stretches of words, within texts, that can hold runs: each word is in its stretch often enough."""
    often = math.floor(least_exponent)
    places, owner = np.arange(len(words.hashes)), words.text_of.astype(np.uint64)
    while True:
        keys = mixed(words.hashes[places] + owner * np.uint64(0x9E3779B97F4A7C15))
        _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        kept = count[which] >= often
        left, text = places[kept], words.text_of[places[kept]]
        heads = np.ones(len(left), bool)
        heads[1:] = (np.diff(left) != 1) | (text[1:] != text[:-1])
        number = np.cumsum(heads) - 1
        size = np.bincount(number, minlength=int(heads.sum())) if len(left) else np.zeros(0, np.int64)
        long = size[number] >= least_length if len(left) else np.zeros(0, bool)
        left, number = left[long], number[long]
        if len(left) == len(places):
            cuts = np.flatnonzero(np.diff(number, prepend=-1))
            return [(int(left[a]), int(left[b - 1]) + 1) for a, b in zip(cuts, [*cuts[1:], len(left)])]
        places, owner = left, number.astype(np.uint64)


def find_runs(docs: DataFrame, least_length: int = 6, least_exponent: float = 4.0, text: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every document.

    ``runs`` lists ``start, length, period`` in words, by start, then period: those of at least
    ``least_length`` words and ``least_exponent`` (2 or more) periods. ``collapsed`` is the text with
    every run cut down to its first period, the words left joined by one space. Words are
    runs of anything but space and the control characters 9 to 13. A null or empty text has no words, no
    runs and an empty ``collapsed``. Rows are taken one by one, whatever their ids; other columns are dropped.
    A document is read whole by one task; memory follows the longest text.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    schema = arrow_schema(FOUND)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", _SLICE):
                words = Words(part.column("text"))
                spots = candidates(words, least_length, least_exponent)
                rows = find([words.hashes[a:b] for a, b in spots], least_length, least_exponent)
                begin = np.array([a for a, _ in spots], np.int64)[rows[:, 0]]
                text_of = words.text_of[begin] if len(rows) else begin
                start = begin + rows[:, 1]
                order = np.lexsort((rows[:, 3], start))
                start, length, period, text_of = start[order], rows[order, 2], rows[order, 3], text_of[order]
                cuts = np.searchsorted(text_of, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(
                    pa.array(cuts.astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(start - words.first[text_of]), pa.array(length), pa.array(period)], ["start", "length", "period"]),
                )
                edge = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, start + length, -1)
                kept = np.cumsum(edge)[:-1] == 0
                columns = [part.column("doc_id"), pa.array(np.diff(words.first).astype(np.int64)), lists, pa.array(_collapsed(words, kept, np.diff(cuts) > 0))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return own.mapInArrow(run, FOUND)


def _collapsed(words: Words, kept: np.ndarray, cut: np.ndarray) -> list[str]:
    out = []
    for i in range(len(words.offsets) - 1):
        low, high = words.offsets[i], words.offsets[i + 1]
        raw = words.bytes[low:high].tobytes()
        left = raw.split()
        if cut[i]:
            left = [left[k] for k in np.flatnonzero(kept[words.first[i] : words.first[i + 1]]).tolist()]
        out.append(b" ".join(left).decode())
    return out
