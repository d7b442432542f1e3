"""A full-text index that grows: stored postings with positions, added to, removed from and merged.

An index is a folder of Parquet tables. Every addition is a segment of its own; a removal names the
documents it hides and the figures to be taken off. The table ``versions`` says which segments
count: its newest version is written last and as one file, so readers see an addition whole or not
at all and a broken write leaves files that nobody reads. One writer at a time.

``postings`` has a row per term and document and one with an empty term per document, whose figures are those
of the collection. Every file is in term order. Documents are dealt to parts and numbered in them; a part is written
by one task as one file, so only texts are exchanged, never postings. ``removed`` has a bit per document, 64 to a row.
Documents of like length share a block; ``blocks`` holds for each term and block how many documents there are, the
highest frequency and the shortest length, in rows that add up. These bound any score in the block, so a ranking
scores only blocks that can hold one of the best.
"""

from __future__ import annotations

import math
import re
import uuid
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators import word_batches
from palaver.operators.search_index import B, DOCUMENT, K1, tokens

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

POSTINGS = "term string, block bigint, part int, doc int, channel string, timestamp string, tf bigint, length int, positions array<int>"
BLOCKS = "of string, term string, block bigint, n bigint, total bigint, max_tf bigint, min_length int"
REMOVED = "of string, part int, word int, bits bigint"
VERSIONS = "version bigint, segment string, added boolean, n bigint"

_EVERY = ""  # the term every document has
_BANDS = 16  # blocks of one slice per doubling of the length
_PART_DOCUMENTS, _PART_BYTES = 4096, 8 << 20  # of a part, about
_ORDER = ["term", "block", "doc"]
_MARGIN = 1e-6  # scores are compared after rounding


# --- reading ---


def _segments(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """The segments of the newest version. Merging keeps their number at the logarithm of the documents'."""
    spark.createDataFrame([], VERSIONS).write.mode("append").parquet(f"{path}/versions")  # makes the folder
    versions = spark.read.schema(VERSIONS).parquet(f"{path}/versions")
    newest = versions.agg(F.max("version").alias("version"))
    return [(r.segment, r.added, r.n) for r in versions.join(newest, "version").filter("segment IS NOT NULL").orderBy("segment").collect()]


def _read(spark: SparkSession, path: str, table: str, ddl: str, segments: Sequence[str]) -> DataFrame:
    if not segments:
        return spark.createDataFrame([], f"{ddl}, segment string")
    folders = [f"{path}/{table}/segment={s}" for s in segments]
    return spark.read.option("basePath", f"{path}/{table}").schema(f"{ddl}, segment string").parquet(*folders)


def _live(spark: SparkSession, path: str, of: Sequence[str] | None = None) -> DataFrame:
    """Postings with their segment, without removed documents."""
    known = _segments(spark, path)
    added = [s for s, a, _ in known if a and (of is None or s in of)]
    found, removals = _read(spark, path, "postings", POSTINGS, added), [s for s, a, _ in known if not a]
    if not removals:  # an empty table in memory has no size that Spark would know, and the join would exchange postings
        return found
    return _marked(found, _read(spark, path, "removed", REMOVED, removals).filter(F.col("of").isin(added)), "left_anti")


def _marked(found: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Postings whose document's bit is set (``left_semi``) or not (``left_anti``)."""
    bits = marks.select(F.col("of").alias("_of"), F.col("part").alias("_part"), F.col("word").alias("_word"), "bits")
    same = (F.col("segment") == F.col("_of")) & (F.col("part") == F.col("_part")) & (F.shiftright("doc", 6) == F.col("_word"))
    return found.join(bits, same & (F.getbit("bits", F.col("doc").bitwiseAND(63)) == 1), how)


def _figures(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``blocks`` of the segments that count; removals are negative."""
    known = _segments(spark, path)
    return _read(spark, path, "blocks", BLOCKS, [s for s, _, _ in known]).filter(F.col("of").isin([s for s, a, _ in known if a]))


def postings(spark: SparkSession, path: str) -> DataFrame:
    """``term, channel, timestamp, tf, length, positions`` of every document."""
    return _live(spark, path).filter(F.col("term") != _EVERY).select("term", *DOCUMENT, "tf", "length", "positions")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``channel, timestamp, length`` of every document, also of those without words."""
    return _live(spark, path).filter(F.col("term") == _EVERY).select(*DOCUMENT, "length")


def term_statistics(spark: SparkSession, path: str) -> DataFrame:
    """``term, df``: in how many documents a term is."""
    found = _figures(spark, path).filter(F.col("term") != _EVERY).groupBy("term").agg(F.sum("n").alias("df"))
    return found.filter("df > 0")


def collection(spark: SparkSession, path: str) -> DataFrame:
    """One row ``n, total``: documents and words, added up from the figures of the segments."""
    every = _figures(spark, path).filter(F.col("term") == _EVERY)
    return every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


# --- writing ---


def _document_postings(messages: DataFrame, slices: int, parts: int) -> DataFrame:
    """Postings of whole messages, dealt to ``parts`` tasks; only the texts are exchanged."""
    part = F.pmod(F.xxhash64(*DOCUMENT), F.lit(parts)).cast("int")
    dealt = messages.select(*DOCUMENT, "text", part.alias("part")).repartitionById(parts, F.col("part"))
    words = dealt.select(*DOCUMENT, "part", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("words"))
    block = (F.log2(F.size("words") + 1) * _BANDS).cast("bigint") * slices + F.col("part") % slices
    return words.select(block.alias("block"), "part", *DOCUMENT, "words").mapInArrow(_postings_of, POSTINGS)


def _postings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents are numbered in the order they come to the task that writes them."""
    seen = 0
    for batch in batches:
        for run in word_batches.runs(batch):
            n = run.num_rows
            terms, row, ends, places, lengths = word_batches.postings(run)
            rows = np.concatenate([np.arange(n), row])  # those of the empty term first
            take = pa.array(rows)
            offsets = np.concatenate([np.zeros(n, np.int64), ends])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array([_EVERY] * n, terms.type), terms]),
                    run.column("block").take(take),
                    run.column("part").take(take),
                    pa.array(rows + seen, pa.int32()),
                    *[run.column(c).take(take) for c in DOCUMENT],
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array(lengths[rows], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, pa.int32())),
                ],
                [c.split()[0] for c in POSTINGS.split(", ")],
            )
            seen += n


def _write_segment(spark: SparkSession, found: DataFrame, path: str) -> tuple[str, bool, int]:
    name = "a" + uuid.uuid4().hex
    found.sortWithinPartitions(*_ORDER).write.parquet(f"{path}/postings/segment={name}")
    _write_figures(_read(spark, path, "postings", POSTINGS, [name]), path, name, 1)
    n = _read(spark, path, "blocks", BLOCKS, [name]).filter(F.col("term") == _EVERY).agg(F.sum("n")).first()[0]
    return name, True, n or 0


def _write_figures(found: DataFrame, path: str, name: str, sign: int) -> None:
    """Figures of postings as they lie in their files: terms and blocks are together there, so nothing is exchanged.

    A term and block in several files or batches has a row for each.
    """

    # a segment travels as its place in this list, not as its name in every row
    names = [s for s, _, _ in _segments(found.sparkSession, path)] + [name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _figures_of(batch, names, sign)

    of = F.array_position(F.lit(names), F.col("segment")).cast("int") - 1
    figures = found.select(of.alias("of"), "term", "block", "length", "tf").mapInArrow(run, BLOCKS)
    figures.sortWithinPartitions("term", "block").write.parquet(f"{path}/blocks/segment={name}")


def _figures_of(batch: pa.RecordBatch, names: Sequence[str], sign: int) -> pa.RecordBatch:
    of, block, tf, length = (batch.column(c).to_numpy() for c in ("of", "block", "tf", "length"))
    term = batch.column("term").dictionary_encode().indices.to_numpy()
    same = (of[1:] == of[:-1]) & (term[1:] == term[:-1]) & (block[1:] == block[:-1])
    first = np.append(0, np.flatnonzero(~same) + 1)
    n, total = np.diff(np.append(first, len(of))), np.add.reduceat(length.astype(np.int64), first)
    bounds = [pa.array(np.maximum.reduceat(tf, first), pa.int64()), pa.array(np.minimum.reduceat(length, first), pa.int32())]
    if sign < 0:  # what is taken off changes no bound
        bounds = [pa.nulls(len(first), b.type) for b in bounds]
    take = pa.array(first)
    return pa.RecordBatch.from_arrays(
        [pa.array(names).take(pa.array(of[first])), *[batch.column(c).take(take) for c in ("term", "block")],
         pa.array(sign * n, pa.int64()), pa.array(sign * total, pa.int64()), *bounds],
        [c.split()[0] for c in BLOCKS.split(", ")],
    )


def _write_removal(spark: SparkSession, path: str, keys: DataFrame) -> list[tuple[str, bool, int]]:
    """Hide the documents of these keys that the index has; figures of what they held are filed as negative."""
    name = "r" + uuid.uuid4().hex
    keys = keys.select(*DOCUMENT).distinct()
    there = _live(spark, path).filter(F.col("term") == _EVERY).join(keys, DOCUMENT, "left_semi")
    bit = F.expr("shiftleft(1L, doc & 63)")
    marks = there.groupBy(F.col("segment").alias("of"), "part", F.shiftright("doc", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    marks.write.parquet(f"{path}/removed/segment={name}")
    gone = _read(spark, path, "removed", REMOVED, [name])
    if gone.isEmpty():
        return []
    _write_figures(_marked(_live(spark, path), gone, "left_semi"), path, name, -1)
    return [(name, False, 0)]


def _commit(spark: SparkSession, path: str, segments: Sequence[tuple[str, bool, int]]) -> None:
    spark.createDataFrame([], VERSIONS).write.mode("append").parquet(f"{path}/versions")
    last = spark.read.schema(VERSIONS).parquet(f"{path}/versions").agg(F.max("version")).first()[0] or 0
    rows = [(last + 1, *s) for s in segments] or [(last + 1, None, None, None)]
    spark.createDataFrame(rows, VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")


def append(messages: DataFrame, path: str, block_size: int = 1024) -> None:
    """Add distinct messages. Documents the index has already are replaced in the same version."""
    spark = messages.sparkSession
    n, size = messages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    slices = max(1, n // (block_size * _BANDS))
    parts = slices * max(1, math.ceil(max(n / _PART_DOCUMENTS, size / _PART_BYTES) / slices))
    segment = _write_segment(spark, _document_postings(messages, slices, parts), path)
    new = _read(spark, path, "postings", POSTINGS, [segment[0]]).filter(F.col("term") == _EVERY)
    removal = _write_removal(spark, path, new)
    _commit(spark, path, [*_segments(spark, path), *removal, segment])


def remove(keys: DataFrame, path: str) -> None:
    """Remove the documents named by ``channel, timestamp``; unknown ones are passed over."""
    spark = keys.sparkSession
    removal = _write_removal(spark, path, keys)
    if removal:
        _commit(spark, path, [*_segments(spark, path), *removal])


def merge(spark: SparkSession, path: str, fan_in: int = 4) -> int:
    """Merge segments of like size, ``fan_in`` or more at a time, and forget what was removed from them.

    Sizes go by powers of ``fan_in``, so that a document is written anew as often as
    the logarithm of the index. Returns how many segments were merged.
    """
    known = _segments(spark, path)
    tiers: dict[int, list[str]] = {}
    for name, added, n in known:
        if added:
            tiers.setdefault(int(math.log(max(n, 1), fan_in) + 1e-9), []).append(name)
    old = next((names for _, names in sorted(tiers.items()) if len(names) >= fan_in), [])
    if not old:
        return 0
    live = _live(spark, path, old)
    # parts of the old segments get numbers of their own; files are sorted where they are read, without an exchange
    parts = live.filter(F.col("term") == _EVERY).groupBy("segment").agg(F.max("part")).collect()
    first, before = F.lit(0), 0
    for of, last in sorted(map(tuple, parts)):
        first, before = F.when(F.col("segment") == of, F.lit(before)).otherwise(first), before + last + 1
    columns = [c.split()[0] for c in POSTINGS.split(", ")]
    segment = _write_segment(spark, live.withColumn("part", F.col("part") + first).select(*columns), path)
    kept = [s for s in known if s[0] not in old]
    if not any(added for _, added, _ in kept):
        kept = []  # removals are about segments that are no more
    _commit(spark, path, [*kept, segment])
    return len(old)


# --- searching ---


def _terms(query: str) -> list[str]:
    found = re.findall(r"[^\W_]+", query.lower())
    if not found:
        raise ValueError("empty search query")
    return found


class _Ranking:
    """BM25 with the figures of a stored index; the few of the query's terms are read once."""

    def __init__(self, spark: SparkSession, path: str, query: str):
        self.spark, self.path, self.terms = spark, path, sorted(set(_terms(query)))
        self.figures = _figures(spark, path).filter(F.col("term").isin([_EVERY, *self.terms]))
        df = {r["term"]: (r["n"], r["total"]) for r in self.figures.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
        self.n, total = df.get(_EVERY, (0, 0))
        self.mean = total / self.n if total else 1.0
        self.idf = {t: math.log(1 + (self.n - df[t][0] + 0.5) / (df[t][0] + 0.5)) for t in self.terms if t in df}

    def _weight(self, tf: str, length: str) -> Column:
        idf = F.lit(0.0)
        for term, value in self.idf.items():
            idf = F.when(F.col("term") == term, F.lit(value)).otherwise(idf)
        return idf * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / self.mean))

    def bounds(self) -> DataFrame:
        """``segment, block, bound``: no document of the block has a higher score."""
        terms = self.figures.filter(F.col("term") != _EVERY).groupBy(F.col("of").alias("segment"), "block", "term")
        held = terms.agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length")).filter("n > 0")
        return held.groupBy("segment", "block").agg(F.sum(self._weight("max_tf", "min_length")).alias("bound"))

    def scores(self, blocks: DataFrame | None = None) -> DataFrame:
        hits = _live(self.spark, self.path).filter(F.col("term").isin(self.terms))
        if blocks is not None:
            hits = hits.join(blocks.select("segment", "block"), ["segment", "block"], "left_semi")
        scored = hits.withColumn("part", self._weight("tf", "length")).groupBy(*DOCUMENT)
        return scored.agg(F.round(F.sum("part"), 6).alias("score"), F.count(F.lit(1)).alias("matched"))

    def needed(self, k: int) -> DataFrame:
        """Blocks that can hold one of the ``k`` best: the ``k`` of highest bound hold ``k`` documents, whose lowest score is the mark."""
        first = self.bounds().orderBy(F.desc("bound"), "segment", "block").limit(k)
        best = self.scores(first).orderBy(F.desc("score")).limit(k)
        count, mark = best.agg(F.count(F.lit(1)), F.min("score")).first()
        return self.bounds().filter(F.col("bound") >= (mark - _MARGIN if count >= k else 0.0))


def top_k(spark: SparkSession, path: str, query: str, k: int = 10) -> DataFrame:
    """Best documents by BM25, ties by channel and id: those of the full ranking, from the blocks that can hold them."""
    ranking = _Ranking(spark, path, query)
    return ranking.scores(ranking.needed(k)).orderBy(F.desc("score"), *DOCUMENT).limit(k)


def blocks_scored(spark: SparkSession, path: str, query: str, k: int = 10) -> tuple[int, int]:
    """How many blocks :func:`top_k` scores, and how many hold a term of the query."""
    ranking = _Ranking(spark, path, query)
    return ranking.needed(k).count(), ranking.bounds().count()


def _positions(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame:
    """Documents that hold all terms, with the positions of term ``i`` in column ``p<i>``."""
    distinct = sorted(set(terms))
    hits = _live(spark, path).filter(F.col("term").isin(distinct)).select(*DOCUMENT, "term", "positions")
    each = [F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"t{i}") for i, t in enumerate(distinct)]
    together = hits.groupBy(*DOCUMENT).agg(F.count(F.lit(1)).alias("n"), *each).filter(F.col("n") == len(distinct))
    return together.select(*DOCUMENT, *[F.col(f"t{distinct.index(t)}").alias(f"p{i}") for i, t in enumerate(terms)])


def _shifted(positions: str, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def phrase(spark: SparkSession, path: str, words: str) -> DataFrame:
    """``channel, timestamp, n``: documents with these words one after the other, and how often."""
    terms = _terms(words)
    starts = F.col("p0")
    for i in range(1, len(terms)):
        starts = F.array_intersect(starts, _shifted(f"p{i}", i))
    found = _positions(spark, path, terms).select(*DOCUMENT, F.size(starts).cast("bigint").alias("n"))
    return found.filter("n > 0")


def near(spark: SparkSession, path: str, first: str, second: str, distance: int) -> DataFrame:
    """``channel, timestamp, n``: occurrences of one word that have the other within so many words, on either side."""
    terms = [*_terms(first), *_terms(second)]
    if len(set(terms)) != 2 or len(terms) != 2:
        raise ValueError("two different words are needed")
    around = F.flatten(F.transform("p1", lambda p: F.sequence(p - distance, p + distance)))
    found = _positions(spark, path, terms).select(*DOCUMENT, F.size(F.array_intersect("p0", around)).cast("bigint").alias("n"))
    return found.filter("n > 0")
