"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

A source's target divided by its size is the number of copies each of its documents should
have: a whole part and a fraction. Fractions are rounded in pairs: words are moved between
two documents until one of them is whole, the direction drawn so that every document keeps
its expectation. The moves keep the words of the pair, so they keep the words of the source.

Documents are dealt to blocks of about ``fan_in`` by hash; a block is folded as one array and
leaves one unsettled document, which goes into a block of the next level. Large documents
come first in a block, so that what is left over tends to be small. A hot source is
thus many blocks, and the tree has ``log(n, fan_in)`` levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import WORD, spare, stored

_UNIT = float(1 << 52)


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, tie``: words of the text (null: none) and a hash that orders ties."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64("doc_id", "text").alias("tie"),
    )


def targets(sized: DataFrame, weights: Sequence[int], budget: float, cap: float) -> DataFrame:
    """``source, source_size, n_docs, target``: shares by weight, capped, the excess shared anew.

    Capping and sharing until none is above its cap ends at one level per unit of weight:
    ``target = min(cap * size, weight * level)``. With sources by rising cap per weight, the
    level is the largest of what is left, divided by the weights left, before each source.
    The windows run over one row per source.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    most = F.lit(cap) * F.col("source_size")
    by_ratio = Window.orderBy((most / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(most).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    return (
        per_source.withColumn("weight", weight)
        .withColumn("level", (F.lit(budget) * F.sum("source_size").over(everything) - before) / left)
        .withColumn("target", F.least(most, F.col("weight") * F.max("level").over(everything)))
        .select("source", "source_size", "n_docs", "target")
    )


def _uniform(seed: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") / F.lit(_UNIT)


def _fold(items: Column, seed: int, level: int) -> Column:
    """Settle the items of one block pair by pair; ``left`` holds at most one unsettled item."""
    item = "struct<size:bigint,tie:bigint,doc_id:bigint,p:double>"
    settled = "struct<tie:bigint,doc_id:bigint,size:bigint,up:int>"
    start = F.struct(F.lit(None).cast(item).alias("left"), F.array().cast(f"array<{settled}>").alias("done"))

    def close(x: Column, up: Column) -> Column:
        return F.struct(x.tie.alias("tie"), x.doc_id.alias("doc_id"), x["size"].alias("size"), up.cast("int").alias("up"))

    def moved(x: Column, words: Column) -> Column:
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.p + words / x["size"]))
        return F.struct(x["size"].alias("size"), x.tie.alias("tie"), x.doc_id.alias("doc_id"), p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        r = acc.left
        r_up, r_down = r["size"] * (1 - r.p), r["size"] * r.p
        x_up, x_down = x["size"] * (1 - x.p), x["size"] * x.p
        up, down = F.least(r_up, x_down), F.least(r_down, x_up)
        rises = _uniform(seed, F.lit(level), r.tie, x.tie) * (up + down) < down
        # whichever of the two reaches a whole number is settled, the other one is left
        r_ends = F.when(rises, r_up <= x_down).otherwise(r_down <= x_up)
        words = F.when(rises, up).otherwise(-down)
        pair = F.struct(
            F.when(r_ends, moved(x, -words)).otherwise(moved(r, words)).alias("left"),
            F.concat(acc.done, F.array(F.when(r_ends, close(r, rises)).otherwise(close(x, ~rises)))).alias("done"),
        )
        whole = F.struct(r.alias("left"), F.concat(acc.done, F.array(close(x, x.p >= 1))).alias("done"))
        first = F.struct(x.alias("left"), acc.done.alias("done"))
        return F.when((x["size"] <= 0) | (x.p <= 0) | (x.p >= 1), whole).when(r.isNull(), first).otherwise(pair)

    return F.aggregate(items, start, step)


def round_copies(items: DataFrame, seed: int, fan_in: int) -> DataFrame:
    """``source, doc_id, tie, size, up`` of items ``source, n_docs, doc_id, tie, size, p``: p rounded to 0 or 1."""
    settled: DataFrame | None = None
    level, current = 0, items
    largest = items.agg(F.max("n_docs")).first()[0] or 0
    while True:
        blocks = F.ceil(F.col("n_docs") / F.lit(fan_in))
        dealt = current.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "tie"), blocks))
        folded = (
            dealt.groupBy("source", "block")
            .agg(F.first("n_docs").alias("n_docs"), F.sort_array(F.collect_list(F.struct("size", "tie", "doc_id", "p")), asc=False).alias("items"))
            .select("source", F.ceil(F.col("n_docs") / F.lit(fan_in)).alias("n_docs"), _fold(F.col("items"), seed, level).alias("fold"))
        )
        folded = stored(folded, "mix-level")
        done = folded.select("source", F.explode("fold.done").alias("item")).select("source", "item.*")
        settled = done if settled is None else settled.unionByName(done)
        current = folded.filter("fold.left IS NOT NULL").select("source", "n_docs", "fold.left.*")
        if largest <= fan_in:
            up = (_uniform(seed, F.lit(-1), F.col("tie")) < F.col("p")).cast("int")
            return settled.unionByName(current.select("source", "tie", "doc_id", "size", up.alias("up")))
        level, largest = level + 1, -(-largest // fan_in)


def mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, seed: int = 20, fan_in: int = 128
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, copies`` of every document.

    Sources in code point order, null last, have the ``weights`` in turn and share ``budget``
    times all words; no target exceeds ``cap`` times its source. ``copies`` is a whole number,
    at most ``cap`` rounded up, ``taken`` is ``copies * size``. A source's taken words differ
    from its target by less than one document. Equal input and seed give equal results.

    Null text has size 0 and is never taken for its words; null ids and repeated rows are
    documents of their own; a null source is a source. An empty table gives no rows.
    """
    sized = stored(sizes(docs), "mix-sizes")
    shares = stored(targets(sized, weights, budget, cap), "mix-targets")
    shares = shares.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rated = sized.join(shares.select(F.col("source").alias("_s"), "n_docs", "rate"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    items = rated.select("source", "n_docs", "doc_id", "tie", "size", (F.col("rate") - F.floor("rate")).alias("p"))
    rounded = stored(round_copies(items, seed, fan_in), "mix-rounded")
    shares = shares.select(F.col("source").alias("_s"), "source_size", "target", F.floor("rate").cast("int").alias("base"))
    copies = F.col("base") + F.col("up")
    return rounded.join(shares, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("bigint").alias("taken"), "source", copies.alias("copies")
    )


def repeat_rows(docs: DataFrame, mixed: DataFrame, group: int = 1000) -> DataFrame:
    """The documents of a mix, each as many times as it is taken; columns as in ``docs``.

    Rows that share ``doc_id`` and ``source`` share their copies evenly. More than ``group`` of them are
    dealt by the hash of the row to groups, whose copies are rounded up or down by a hash.
    """
    id_, source, copies, rows, lane, own = (spare(docs, f"mix_{n}") for n in ("id", "source", "copies", "rows", "lane", "own"))
    key = [F.col("doc_id").alias(id_), F.col("source").alias(source)]
    shares = mixed.groupBy(*key).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows)).filter(F.col(copies) > 0)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_)) & F.col("source").cast("string").eqNullSafe(F.col(source))
    joined = docs.join(shares, same).drop(id_, source)
    single = joined.filter(F.col(rows) == 1).withColumn(own, F.col(copies))
    hashed = F.xxhash64(*docs.columns)
    several = joined.filter(F.col(rows) > 1).withColumn(lane, F.pmod(hashed, F.ceil(F.col(rows) / group)))
    window = Window.partitionBy("doc_id", "source", lane)
    number, members = F.row_number().over(window.orderBy(hashed)), F.count(F.lit(1)).over(window)
    exact = F.col(copies) * members / F.col(rows)
    coin = F.pmod(F.xxhash64("doc_id", "source", lane), F.lit(1 << 20)) / float(1 << 20) < exact - F.floor(exact)
    dealt = F.when(F.col(rows) <= group, F.col(copies)).otherwise(F.floor(exact) + coin.cast("bigint"))
    several = several.withColumn(own, F.floor(dealt / members) + (number <= dealt % members).cast("bigint")).drop(lane)
    taken = single.unionByName(several).filter(F.col(own) > 0)
    return taken.withColumn(own, F.explode(F.sequence(F.lit(1), F.col(own).cast("int")))).select(*docs.columns)
