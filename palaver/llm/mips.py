"""Exact top-k by inner product over norm-bucketed vectors.

Vectors are grouped by length into bands, bands are split into lanes. A query's bound is its
k-th best product in the lane of the longest vectors. In a lane, a product that reaches the
bound needs a cosine of at least ``bound / (|q| * longest in the lane)``: above 1 the lane is
skipped, otherwise the lane is pruned by length (where lengths differ enough) or by the
query's largest coordinates, whose feasible range follows from that cosine. What is left is verified
with exact integer products.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm import vectors as V
from palaver.llm.common import ship, stored

ship(__name__)

LANE, BLOCK, BANDS, FOCUS = 8192, 2048, 4, 3
_SLACK = 1e-9


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each vector of ``queries`` among all other ``vectors``.

    Components are ``floor(scale * x)``; scores are integer inner products, ties go to the
    smaller id. Vectors that are null, empty or hold null or non-finite components take no
    part, nor do null ids; vectors of another width than the query's are no candidates. A row
    is no candidate of a query with its own id; rows that share another id are all
    candidates. Products must fit 63 bits. An empty table gives no rows.
    """
    def whole(df: DataFrame) -> DataFrame:
        v = F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("double"))
        return V.usable(df).withColumn("v", v).withColumn("dim", F.size("v"))

    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    band = F.when(squared > 0, F.floor(F.log2(squared) * F.lit(BANDS / 2))).otherwise(-1).cast("int")
    dealt, n_lanes = V.lanes(stored(whole(vectors).withColumn("band", band), "mips-vectors"), ["dim", "band"], LANE)
    asked, n_blocks = V.lanes(stored(whole(queries), "mips-queries").dropDuplicates(["vec_id"]), ["dim"], BLOCK)
    packed = stored(V.pack(dealt, "lane"), "mips-lanes")
    asked = asked.withColumnRenamed("lane", "block")
    # the lanes of the longest band of each width give the bounds
    longest = dealt.groupBy("dim").agg(F.max(F.struct("band", "lane")).alias("m")).select(F.col("m.lane").alias("lane"))
    first = packed.join(F.broadcast(longest), "lane")  # a row per width
    seeds = V.search(first, V.pack(asked, "block"), n_lanes, n_blocks, _finder(k), "bigint")
    floor = seeds.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    bound = F.when(F.col("n") >= k, F.col("low").cast("double")).otherwise(float("-inf"))
    bounded = asked.join(floor.select(F.col("query_id").alias("vec_id"), bound.alias("bound")), "vec_id", "left")
    bounded = bounded.withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    return V.best(V.search(packed, V.pack(bounded, "block", "bound"), n_lanes, n_blocks, _finder(k, pruned=True), "bigint"), k)


def _finder(k: int, pruned: bool = False):
    def find(lane, block):
        ids, _, rows = lane
        queries, bounds, asked = block
        lengths = np.sqrt((rows * rows).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        ids, rows, lengths = ids[order], rows[order], lengths[order]
        most = float(np.abs(rows).max(initial=0)) * float(np.abs(asked).max(initial=0)) * rows.shape[1]
        exact_in_doubles = most < 2.0**53
        whole, asked_whole = (rows, asked) if exact_in_doubles else (rows.astype(np.int64), asked.astype(np.int64))
        unit = np.asfortranarray(rows / np.where(lengths > 0, lengths, 1.0)[:, None])
        for i, query in enumerate(queries):
            places = _candidates(asked[i], bounds[i], unit, lengths) if pruned else slice(None)
            if places is None:
                continue
            found = ids[places]
            products = (whole[places] @ asked_whole[i]).astype(np.int64)
            other = found != query
            found, products = found[other], products[other]
            if len(found):
                chosen = V.top(found, products, k)
                yield query, found[chosen], products[chosen]

    return find


def _candidates(query: np.ndarray, bound: float, unit: np.ndarray, lengths: np.ndarray):
    """Places in the lane, longest vectors first, whose product may reach the bound; None: no place."""
    length = math.sqrt(float(query @ query))
    if length == 0 or not math.isfinite(bound) or bound <= 0:
        return slice(None)
    needed = bound / length * (1 - _SLACK)
    if lengths[0] < needed:
        return None
    long_enough = int(np.searchsorted(-lengths, -needed, "right"))
    if lengths[-1] < 0.9 * lengths[0]:
        return slice(0, long_enough)
    cosine = min(1.0, needed / lengths[0])
    mask = np.ones(long_enough, bool)
    direction = query / length
    for f in np.argsort(-np.abs(direction), kind="stable")[:FOCUS]:
        spread = math.sqrt(max(0.0, (1 - cosine * cosine) * (1 - direction[f] ** 2))) + _SLACK
        values = unit[:long_enough, f]
        middle = direction[f] * cosine
        # the angles between the query, the axis and the candidate; a pole inside the cone ends the range
        low = middle - spread if direction[f] >= -cosine else -1.0
        high = middle + spread if direction[f] <= cosine else 1.0
        mask &= (values >= low - _SLACK) & (values <= high + _SLACK)
    return np.flatnonzero(mask)
