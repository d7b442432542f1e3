"""Vector tables in lanes: a stated query set against all rows, in blocks.

Rows that can take part are dealt to lanes of a bounded number of vectors, queries to blocks
of a bounded number. A lane and a block meet in one cell; each cell is a task's group of
two packed rows, so memory does not grow with the table, and neither side is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import ship

ship(__name__)

PACKED = "lane int, block int, kind int, payload binary"
HITS = "query_id bigint, vec_id bigint, score {}"


def usable(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """``vec_id, v`` as doubles, without vectors that are null, empty or hold null or non-finite components."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    kept = kept.filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").filter(~F.exists("v", odd))
    return kept.filter(F.exists("v", lambda x: x != 0)) if nonzero else kept


def lanes(rows: DataFrame, group: list[str], most: int) -> tuple[DataFrame, int]:
    """Column ``lane``: groups split by hash into lanes of about ``most`` rows. Also the number of lanes.

    The table of groups is one row per combination of ``group``, which must be few.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).orderBy(*group).collect()
    table, first = [], 0
    for row in sizes:
        parts = math.ceil(row["_n"] / most)
        table.append((*[row[g] for g in group], first, parts))
        first += parts
    kinds = ", ".join(f"{g} {rows.schema[g].dataType.simpleString()}" for g in group)
    known = rows.sparkSession.createDataFrame(table, f"{kinds}, _first int, _parts int")
    # bounded: a row per group
    dealt = rows.join(F.broadcast(known), group)
    return dealt.withColumn("lane", (F.col("_first") + F.pmod(F.xxhash64("vec_id"), F.col("_parts"))).cast("int")).drop("_first", "_parts"), first


def pack(rows: DataFrame, key: str, carry: str | None = None) -> DataFrame:
    """One row per ``key``: ids, the vectors as a matrix, and a number carried along with each."""

    def packed(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        values = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
        extra = table[carry].to_numpy().astype("<f8") if carry else np.zeros(len(ids))
        order = np.argsort(ids, kind="stable")
        head = np.array([len(ids), len(values) // len(ids)], "<i8").tobytes()
        payload = head + ids[order].astype("<i8").tobytes() + extra[order].tobytes() + values.reshape(len(ids), -1)[order].tobytes()
        return pa.table({key: pa.array([table[key][0].as_py()], pa.int32()), "payload": pa.array([payload], pa.binary())})

    columns = [key, "vec_id", "v", *([carry] if carry else [])]
    return rows.select(*columns).groupBy(key).applyInArrow(packed, f"{key} int, payload binary")


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, d = np.frombuffer(payload, "<i8", 2)
    ids = np.frombuffer(payload, "<i8", n, 16)
    extra = np.frombuffer(payload, "<f8", n, 16 + 8 * n)
    return ids, extra, np.frombuffer(payload, "<f8", n * d, 16 + 16 * n).reshape(n, d)


def search(packed_lanes: DataFrame, packed_blocks: DataFrame, n_lanes: int, n_blocks: int, find, kind: str) -> DataFrame:
    """Hits of ``find(lane, block)`` over all cells; lanes and blocks of other widths do not meet."""

    def every(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    left = packed_lanes.select("lane", "payload", every(max(1, n_blocks), "block")).filter(F.lit(n_blocks > 0))
    right = packed_blocks.select("block", "payload", every(max(1, n_lanes), "lane")).filter(F.lit(n_lanes > 0))

    def cell(lane: pa.Table, block: pa.Table) -> pa.Table:
        queries, found, scores = [], [], []
        if lane.num_rows and block.num_rows:
            one, other = unpack(lane["payload"][0].as_py()), unpack(block["payload"][0].as_py())
            if one[2].shape[1] == other[2].shape[1]:
                for query, ids, values in find(one, other):
                    queries.append(np.full(len(ids), query))
                    found.append(ids)
                    scores.append(values)
        flat = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
        types = {"double": pa.float64(), "bigint": pa.int64()}
        return pa.table({"query_id": flat(queries, pa.int64()), "vec_id": flat(found, pa.int64()), "score": flat(scores, types[kind])})

    return left.groupBy("lane", "block").cogroup(right.groupBy("lane", "block")).applyInArrow(cell, HITS.format(kind))


def best(hits: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest scores of each query, ties to the smaller id."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        enough = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= enough)
    else:
        places = np.arange(len(ids))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]
