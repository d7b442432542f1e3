"""Near-duplicate documents by DartMinHash signatures.

A document is a weighted set: its runs of five words (all its words if it has fewer), each
weighing as often as it occurs; similarity is the weighted Jaccard of two sets. A run of
weight ``w`` is a region of width ``w``; darts fall into the region by a Poisson process
whose positions, coordinates and ranks are hashes of the run alone, so equal regions get
equal darts. Of the darts up to a rank that leaves hardly any of the ``coordinates`` empty,
the earliest of each coordinate is kept (and the rank doubled where one was empty): about
``k (log k + 4)`` darts a document, however long it is. Two sets agree in a coordinate with
the probability of their similarity.

Bands of six coordinates are joined. Exact copies are one node from the start. Every node is
first compared with the smallest one it shares a band with; what of a band is then still in different
components is compared with pivots, round by round, until each bucket is one
component or all of its cross pairs have been compared: no pair that shares a band is
skipped, and a bucket of copies costs a number of comparisons in proportion to its size.
Cross pairs are first compared inside the join by two bits of each of 2,048 coordinates, which
passes a pair of the similarity asked for but for one in 10^6 and few pairs below 0.7. The
comparison that counts is exact, on the sets themselves.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.llm.common import arrow_schema, byte_slices, drop_shuffles, give_back, ship, stored
from palaver.llm.graph import components
from palaver.llm.wordhash import Words, mixed

ship(__name__)

SHINGLE, COORDINATES, ROWS = 5, 240, 6
SKETCH = 2048
SIMILAR = (4, 5)  # 0.8 as a fraction: counts are compared as integers
PIVOTS = (4, 16, 64, 256)  # a bucket's new pivots in each round; the last number goes on
_SLICE = 1 << 20
_EARLIEST = 1 << 21
_FILTER_BITS = 26

SIGNATURE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("copy_of", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
ELEMENTS = T.StructType(
    [
        T.StructField("node", T.LongType()),
        T.StructField("elements", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.ArrayType(T.LongType())),
    ]
)


def elements(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of every text's weighted runs, and where each text's cells begin (and the total)."""
    counts = np.diff(words.first)
    cells = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(cells)])
    out = np.empty(first[-1], np.uint64)
    long = counts >= SHINGLE
    out[np.repeat(long, cells)] = words.runs(SHINGLE, at=np.flatnonzero(words.whole(SHINGLE)))
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        out[first[short]] = mixed(words.runs(n, at=words.first[short]) + np.uint64(n))
    for a, b in zip(first[:-1], first[1:]):
        out[a:b].sort()
    # the n-th occurrence of a run in its text is its n-th cell
    starts = np.ones(len(out), bool)
    starts[1:] = out[1:] != out[:-1]
    starts[first[:-1][cells > 0]] = True
    heads = np.flatnonzero(starts)
    nth = np.arange(len(out)) - np.repeat(heads, np.diff(heads, append=len(out)))
    again = nth > 0
    out[again] = mixed(out[again] + nth[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out, first


def signatures(cells: np.ndarray, first: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate, a row per text; texts without cells have zeros.

    Darts are thrown round by round, one of each cell, and only the earliest of each coordinate are kept, for as many
    texts at a time as have ``_EARLIEST`` coordinates, so memory follows neither the darts nor the texts.
    """
    weights = np.diff(first)
    out = np.zeros((len(weights), k), np.uint64)
    waiting = np.flatnonzero(weights > 0)
    reach = k * (math.log(k) + 4.0)
    while len(waiting):
        full = np.concatenate([_throw(cells, first, own, out, reach) for own in np.array_split(waiting, -(-len(waiting) * k // _EARLIEST))])
        waiting, reach = waiting[~full], reach * 2
    return out


def _throw(cells: np.ndarray, first: np.ndarray, texts: np.ndarray, out: np.ndarray, reach: float) -> np.ndarray:
    """Fill the rows of ``out`` whose coordinates all have a dart up to ``reach``; says which texts those are."""
    k, sizes = out.shape[1], first[texts + 1] - first[texts]
    owner = np.repeat(np.arange(len(texts)), sizes)
    seed = cells[np.repeat(first[texts] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(owner))]
    limit = (reach / sizes)[owner]
    rank = np.zeros(len(seed))
    earliest, found = np.full(len(texts) * k, np.inf), np.zeros(len(texts) * k, np.uint64)
    while len(seed):
        seed = mixed(seed + np.uint64(0x9E3779B97F4A7C15))
        rank = rank - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        hit = rank <= limit
        owner, limit, rank, seed = owner[hit], limit[hit], rank[hit], seed[hit]
        dart = mixed(seed ^ np.uint64(0xA24BAED4963EE407))
        at = owner * k + (dart % np.uint64(k)).astype(np.int64)
        np.minimum.at(earliest, at, rank)
        best = earliest[at] == rank
        found[at[best]] = dart[best]
    full = np.isfinite(earliest).reshape(-1, k).all(axis=1)
    out[texts[full]] = found.reshape(-1, k)[full]
    return full


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, k = signature.shape
    part = mixed(signature + np.arange(k, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).reshape(n, k // rows, rows)
    return mixed(part.sum(axis=2, dtype=np.uint64) + np.arange(k // rows, dtype=np.uint64)).astype(np.int64)


def sketch(signature: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, as two bit planes of 64-bit numbers."""
    planes = []
    for bit in (20, 40):
        bits = (signature >> np.uint64(bit) & np.uint64(1)).astype(np.uint8)
        planes.append(np.ascontiguousarray(np.packbits(bits, axis=1)).view("<i8"))
    return np.hstack(planes)


def _alike(x: Column, y: Column) -> Column:
    """Whether two sketches leave it open that the similarity is reached: five deviations below what it makes expected."""
    half = SKETCH // 64
    unlike = sum(F.bit_count((x[i].bitwiseXOR(y[i])).bitwiseOR(x[half + i].bitwiseXOR(y[half + i]))) for i in range(half))
    agreed = SIMILAR[0] / SIMILAR[1] + (1 - SIMILAR[0] / SIMILAR[1]) / 4
    return unlike <= F.lit(math.ceil(SKETCH * (1 - agreed) + 5 * math.sqrt(SKETCH * agreed * (1 - agreed))))


def _lists(values: np.ndarray, present: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(np.where(present, values.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[present].ravel()))


def sign(docs: DataFrame) -> DataFrame:
    """``doc_id, copy_of, bands``: a digest of the text and its band hashes (none without words)."""
    schema = arrow_schema(SIGNATURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", _SLICE):
                words = Words(part.column("text"))
                cells, first = elements(words)
                keys = bands(signatures(cells, first))
                copies = [
                    hashlib.blake2b(words.bytes[a:b], digest_size=16).digest() for a, b in zip(words.offsets[:-1], words.offsets[1:])
                ]
                lists = _lists(keys, np.diff(first) > 0).cast(schema.field("bands").type)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(copies, pa.binary()), lists], schema=schema)
        give_back()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNATURE)


def element_sets(docs: DataFrame) -> DataFrame:
    """``node, elements, sketch`` of documents ``node, text``: the cells of the weighted set for exact comparison, and a sketch."""
    schema = arrow_schema(ELEMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", _SLICE):
                cells, first = elements(Words(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(cells.astype(np.int64)))
                short = _lists(sketch(signatures(cells, first, SKETCH)), np.diff(first) > 0)
                columns = [part.column("node"), lists.cast(schema.field("elements").type), short.cast(schema.field("sketch").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        give_back()

    return docs.mapInArrow(run, ELEMENTS)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets reach the similarity, compared exactly; few other sets than theirs are exchanged."""
    pairs = stored(pairs, "minhash-pairs")
    sets = sets.filter(_perhaps(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())(F.col("node")))
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    either = F.size("x") + F.size("y") - both
    close = both * SIMILAR[1] >= either * SIMILAR[0]
    return pairs.join(right, "b").join(left, "a").filter(close).select("a", "b").distinct()


def _perhaps(nodes: DataFrame) -> Callable[[Column], Column]:
    """A test that all of the nodes pass, and few others while there are under some millions: a Bloom filter of at most 8 MB.

    Beyond that more and more others pass it, which only means that they are sorted out later.
    """
    bits = min(_FILTER_BITS, max(10, (16 * nodes.count()).bit_length()))
    places = nodes.select(F.explode(F.array(*[_bit(F.col("node"), turn, bits) for turn in range(3)])).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT))) AS set"))
    filled = np.zeros(1 << (bits - 6), np.uint64)
    for batch in words.toArrow().to_batches():
        filled[np.asarray(batch.column("word"))] = np.asarray(batch.column("set")).astype(np.uint64)

    @F.pandas_udf("boolean")
    def passes(first: pd.Series, second: pd.Series, third: pd.Series) -> pd.Series:
        found = np.ones(len(first), bool)
        for at in (first, second, third):
            at = at.fillna(0).to_numpy(np.int64)
            found &= (filled[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pd.Series(found)

    return lambda node: passes(*[_bit(node, turn, bits) for turn in range(3)])


def _bit(node: Column, turn: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(turn), node), 64 - bits)


def near_duplicates(docs: DataFrame, sketched: bool = True) -> DataFrame:
    """``doc_id, class_id`` of every row; the class is named by its smallest document.

    Documents are linked by a weighted Jaccard similarity of 0.8 or more on runs of five
    words; classes are the connected components. Null and empty texts, and texts of white
    space, are classes of their own. Rows with a null id have a null class and join no
    other; rows that share an id are one document. An empty table gives no rows.
    Without ``sketched`` every cross pair that shares a band is compared exactly.
    """
    signed = stored(sign(docs), "minhash-signatures")
    known = signed.filter("doc_id IS NOT NULL AND size(bands) > 0")
    nodes = stored(known.groupBy("copy_of").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")), "minhash-nodes")
    spread = nodes.select("node", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("node").alias("_low"), F.max("node").alias("_high")).filter("_low < _high").select("band")
    members = stored(spread.join(shared, "band"), "minhash-members")
    contenders = stored(members.select("node").distinct(), "minhash-contenders")
    # copies of a node's text are other documents, so the node's own id finds its text
    own = docs.select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("string").alias("text")).filter("node IS NOT NULL")
    own = own.filter(_perhaps(contenders)(F.col("node"))).join(contenders, "node", "left_semi")
    sets = stored(element_sets(own), "minhash-sets")

    # first each node with one other only, the smallest it shares a band with
    least = members.groupBy("band").agg(F.min("node").alias("b"))
    pairs = members.join(least, "band").filter("node <> b").groupBy(F.col("node").alias("a")).agg(F.min("b").alias("b"))
    edges = stored(similar(pairs, sets), "minhash-edges")
    left = members
    for turn in itertools.count():
        drop_shuffles(docs.sparkSession)
        roots = components(edges)
        drop_shuffles(docs.sparkSession)
        named = left.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = stored(named, "minhash-left")
        split = named.groupBy("band").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high").select("band")
        open_ = named.join(split, "band")
        open_ = stored(open_ if turn else open_.join(sets.select("node", "sketch"), "node"), "minhash-open")
        if open_.isEmpty():
            break
        lane = F.pmod(F.xxhash64("node"), F.lit(PIVOTS[min(turn, len(PIVOTS) - 1)]))
        pivots = open_.groupBy("band", lane.alias("lane")).agg(F.min(F.struct("node", "root", "sketch")).alias("p"))
        pivots = stored(pivots.select(F.col("band").alias("p_band"), "p"), "minhash-pivots")
        across = (F.col("band") == F.col("p_band")) & (F.col("root") != F.col("p.root"))
        if sketched:
            across &= _alike(F.col("sketch"), F.col("p.sketch"))
        pairs = open_.join(pivots, across).select(F.greatest("node", "p.node").alias("a"), F.least("node", "p.node").alias("b"))
        edges = stored(edges.unionByName(similar(pairs.distinct(), sets)), "minhash-edges")
        done = pivots.select(F.col("p_band").alias("band"), "p.node")
        left = open_.join(done, ["band", "node"], "left_anti").select("band", "node", "sketch")
    named_nodes = nodes.select("copy_of", "node").join(roots, "node", "left").select("copy_of", F.coalesce("root", "node").alias("class_id"))
    per_row = signed.select("doc_id", F.when(F.col("doc_id").isNotNull() & (F.size("bands") > 0), F.col("copy_of")).alias("copy_of"))
    return per_row.join(named_nodes, "copy_of", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One document of each class, its smallest. Rows without an id stay.

    Of rows that share an id the one of smallest text hash stays, ties by text.
    """
    kept = classes.filter("doc_id = class_id").select(F.col("doc_id").alias("_id")).distinct()
    named = docs.join(kept, F.col("doc_id") == F.col("_id"), "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", F.xxhash64(*[c for c in docs.columns if c != "text"]))
    first = named.select(F.struct(*docs.columns).alias("row"), "doc_id", F.row_number().over(order).alias("turn")).filter("turn = 1").select("row.*")
    return first.unionByName(docs.filter("doc_id IS NULL"))
