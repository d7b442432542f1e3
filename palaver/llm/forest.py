"""Approximate nearest neighbours by a forest of hash prefixes.

A tree hashes a vector to a long string: after a random rotation, each group of sixteen
coordinates gives a symbol, the place and sign of its largest one. A lane holds a sorted
array of strings per tree. A query goes down to its longest matching prefix in every tree,
then up in all trees at once, one symbol at a time, until enough different rows share a
prefix with it, and one symbol further. The rows that share most symbols with it, over all
trees, are the candidates; their cosines are computed on the original vectors.

Every vector is in one lane, and every lane answers every query. A level of the trees has
too few rows or nearly all, so it is the count of shared symbols that sets the number of
candidates: the wanted one exactly, whatever the size of the table.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm import vectors as V
from palaver.llm.common import ship, stored

ship(__name__)

LANE, BLOCK = 16384, 4096
TREES, GROUP, SYMBOL_BITS, DEPTH = 128, 16, 5, 12
SHARE, LEAST = 0.08, 256


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = TREES, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each vector of ``queries`` among all other ``vectors``.

    Scores are cosines in double precision; ties go to the smaller id. Each lane gives
    ``share`` of its rows (``least`` in number, all if it has fewer) as candidates.
    Vectors that are null, empty, zero or hold null or non-finite components take no part,
    nor do null ids; vectors of another width than the query's are no candidates. A row is
    no candidate of a query with its own id. An empty table gives no rows.
    """
    rows = stored(V.usable(vectors, nonzero=True).withColumn("dim", F.size("v")), "forest-vectors")
    asked = stored(V.usable(queries, nonzero=True).withColumn("dim", F.size("v")), "forest-queries").dropDuplicates(["vec_id"])
    dealt, n_lanes = V.lanes(rows, ["dim"], LANE)
    asked, n_blocks = V.lanes(asked, ["dim"], BLOCK)
    blocks = V.pack(asked.withColumnRenamed("lane", "block"), "block")
    return V.best(V.search(V.pack(dealt, "lane"), blocks, n_lanes, n_blocks, _finder(k, trees, share, least), "double"), k)


@functools.lru_cache(maxsize=4)
def _rotations(dim: int, trees: int) -> list[np.ndarray]:
    """Per tree, enough random orthogonal maps for a string of ``DEPTH`` symbols. Widths below a group are padded."""
    rng = np.random.Generator(np.random.PCG64(dim))
    wide = max(GROUP, -(-dim // GROUP) * GROUP)
    each = wide // GROUP
    return [
        np.hstack([np.linalg.qr(rng.normal(size=(wide, wide)))[0][:dim] for _ in range(-(-DEPTH // each))])[:, : DEPTH * GROUP] for _ in range(trees)
    ]


def strings(rows: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """The hash strings as numbers, the first symbol in the leading bits."""
    turned = (rows @ rotation).reshape(len(rows), -1, GROUP)
    place = np.abs(turned).argmax(axis=2)
    sign = np.take_along_axis(turned, place[:, :, None], axis=2)[:, :, 0] > 0
    symbols = (place * 2 + sign).astype(np.uint64)
    out = np.zeros(len(rows), np.uint64)
    for j in range(symbols.shape[1]):
        out = out << np.uint64(SYMBOL_BITS) | symbols[:, j]
    return out << np.uint64(SYMBOL_BITS * (DEPTH - symbols.shape[1]))


def _unit(rows: np.ndarray) -> np.ndarray:
    tame = _tame(rows)
    return tame / np.sqrt((tame * tame).sum(axis=1))[:, None]


def _shared(n: int, orders: list[np.ndarray], low: np.ndarray, high: np.ndarray, wanted: int) -> np.ndarray:
    """Of each row the symbols it shares with the query, up to the level above the one that meets ``wanted`` rows."""
    shared, met, enough = np.zeros(n, np.int64), [], False
    for level in range(DEPTH):
        trees = np.flatnonzero(high[:, level] > low[:, level])
        met += [orders[t][a:b] for t, a, b in zip(trees.tolist(), low[trees, level].tolist(), high[trees, level].tolist())]
        if enough or level == DEPTH - 1 or sum(map(len, met)) + np.count_nonzero(shared) >= wanted:
            if met:
                shared += np.bincount(np.concatenate(met), minlength=n)
            met = []
            if enough:
                break
            enough = np.count_nonzero(shared) >= wanted
    return shared


def _finder(k: int, trees: int, share: float, least: int):
    def find(lane, block):
        ids, _, rows = lane
        queries, _, asked = block
        n = len(ids)
        wanted = max(least, k, math.ceil(share * n))
        unit, unit_asked = _unit(rows), _unit(asked)
        orders, ranges = [], []
        if n > wanted:
            for rotation in _rotations(rows.shape[1], trees):
                codes, own = strings(unit, rotation), strings(unit_asked, rotation)
                order = np.argsort(codes, kind="stable").astype(np.int32)
                codes = codes[order]
                orders.append(order)
                per_level = []
                for level in range(DEPTH, 0, -1):  # from the whole string up to one symbol
                    cut = np.uint64(SYMBOL_BITS * (DEPTH - level))
                    low = own >> cut << cut
                    per_level.append((np.searchsorted(codes, low), np.searchsorted(codes, low + ((np.uint64(1) << cut) - np.uint64(1)), "right")))
                ranges.append(per_level)
        low = np.array([[r[0] for r in tree] for tree in ranges]) if ranges else None
        high = np.array([[r[1] for r in tree] for tree in ranges]) if ranges else None
        for i, query in enumerate(queries):
            places = np.arange(n)
            if n > wanted:
                shared = _shared(n, orders, low[:, :, i], high[:, :, i], wanted)
                shared[ids == query] = -1
                # of equal counts the smaller ids, so that the choice is fixed
                places = np.sort(np.argpartition(shared * n - places, n - wanted)[n - wanted :])
            places = places[ids[places] != query]
            rough = unit[places] @ unit_asked[i]
            if len(places) > k:  # exact scores for all that rounding could bring among the first k
                places = places[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9]
            if len(places):
                exact = cosines(rows[places], asked[i])
                chosen = V.top(ids[places], exact, k)
                yield query, ids[places][chosen], exact[chosen]

    return find


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row, in the same order of additions for equal vectors, so equal vectors tie."""
    rows, query = _tame(rows), _tame(query[None])[0]
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def _tame(rows: np.ndarray) -> np.ndarray:
    """Rows whose squares would leave the range of doubles, scaled; the others as they are."""
    most = np.abs(rows).max(axis=1)[:, None]
    return np.where((most > 1e100) | (most < 1e-100), rows / most, rows)
