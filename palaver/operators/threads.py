"""Threads: which messages are parents, and their replies.

A message is a parent iff its declared ``reply_count`` is positive. Replies stay a
long table throughout: joins and renderings never need a whole thread in one row,
so a thread of any length is just more rows. :func:`nest` builds the array form in
pages of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators import clean
from palaver.schema import MESSAGE_FIELDS

PAGE_SIZE = 1000

_THREAD = ["channel", "parent_ts"]


def message_struct(prefix: str = "") -> Column:
    """The seven serialised fields in order."""
    return F.struct(*[F.col(prefix + name).alias(name) for name in MESSAGE_FIELDS])


def parents(messages: DataFrame) -> DataFrame:
    return messages.filter(F.coalesce("reply_count", F.lit(0)) > 0)


def standalone(messages: DataFrame, expand_threads: bool = True) -> DataFrame:
    """Messages that are no thread parent; all of them when threads are not expanded."""
    return messages.filter(F.coalesce("reply_count", F.lit(0)) <= 0) if expand_threads else messages


def standalone_without(messages: DataFrame, parent_ids: DataFrame) -> DataFrame:
    """Set difference for tables that carry no declared count: messages minus ``(channel, parent_ts)``."""
    ids = parent_ids.select("channel", F.col("parent_ts").alias("timestamp"))
    return messages.join(ids, ["channel", "timestamp"], "left_anti")


def with_reply_counts(messages: DataFrame, replies: DataFrame) -> DataFrame:
    """Declare ``reply_count`` from the replies found, before any filter on them."""
    counts = replies.groupBy(F.col("channel"), F.col("parent_ts").alias("timestamp")).agg(
        F.count(F.lit(1)).cast("int").alias("reply_count")
    )
    return (
        messages.drop("reply_count")
        .join(counts, ["channel", "timestamp"], "left")
        .withColumn("reply_count", F.coalesce("reply_count", F.lit(0)))
    )


def parent_ids(parents: DataFrame) -> DataFrame:
    return parents.select("channel", F.col("timestamp").alias("parent_ts"))


def thread_replies(replies: DataFrame, parents: DataFrame, exclude_bots: bool = False) -> DataFrame:
    """Replies of surviving parents. Date bounds do not apply to replies; bots go before the join."""
    if exclude_bots:
        replies = clean.exclude_bots(replies)
    return replies.join(parent_ids(parents), _THREAD, "left_semi")


def reply_totals(replies: DataFrame) -> DataFrame:
    """Per thread: number of replies and last position. Aggregated before the exchange."""
    return replies.groupBy(*_THREAD).agg(
        F.count(F.lit(1)).alias("n_replies"), F.max("pos").alias("last_pos")
    )


def reply_key() -> Column:
    """What tells replies of a thread apart: the id, without one the label and text."""
    return F.when(F.coalesce("timestamp", F.lit("")) != "", F.concat(F.lit("id "), F.col("timestamp"))).otherwise(
        F.concat_ws("\n", F.lit("text"), "datetime", "user", "text")
    )


def nest(parents: DataFrame, replies: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Rows ``(channel, parent, page, replies, reply_count, n_replies)``.

    Replies are grouped by ``(channel, parent_ts, pos div page_size)``, so no array
    exceeds a page and a huge thread spreads over many tasks. A thread below the page
    size is one row with page 0; longer ones continue in further rows, each naming
    its parent. Parents without replies keep an empty array; replies of other messages
    fall away in the join. First pages meet their parents by thread, where each has one row; only
    further pages, which are few, are exchanged with the parents by page.
    """
    place = F.coalesce("pos", F.lit(0))
    first = (place >= 0) & (place < page_size)
    keys = [*_THREAD, "page"]
    item = F.struct("pos", message_struct().alias("m"))
    heads = parents.select(
        "channel",
        F.col("timestamp").alias("parent_ts"),
        message_struct().alias("parent"),
        "reply_count",
    )
    opening = replies.filter(first).groupBy(*_THREAD).agg(F.collect_list(item).alias("_items"), F.count(F.lit(1)).alias("_n"))
    further = replies.filter(~first).withColumn("page", F.floor(place / page_size).cast("bigint"))
    more = further.groupBy(*_THREAD).agg(F.count(F.lit(1)).alias("_more"))
    total = (F.coalesce("_n", F.lit(0)) + F.coalesce("_more", F.lit(0))).cast("bigint").alias("n_replies")
    counted = heads.join(opening, _THREAD, "left").join(more, _THREAD, "left").select("*", total)
    # a thread whose replies all lie on further pages has no page 0
    start = counted.filter("_n IS NOT NULL OR _more IS NULL").withColumn("page", F.lit(0).cast("bigint"))

    sizes = replies.groupBy(*_THREAD).agg(F.count(F.lit(1)).alias("n_replies"))
    pages = heads.join(further.select(*keys).distinct(), _THREAD).join(sizes, _THREAD)
    rest = pages.join(further.groupBy(*keys).agg(F.collect_list(item).alias("_items")), keys)

    columns = ["channel", "parent", "page", "_items", "reply_count", "n_replies"]
    rows = start.select(*columns).unionByName(rest.select(*columns))
    listed = F.transform(F.sort_array("_items"), lambda r: r["m"])
    empty = F.array().cast(rows.select(listed.alias("r")).schema["r"].dataType)
    return rows.select(
        "channel",
        "parent",
        "page",
        F.coalesce(listed, empty).alias("replies"),
        declared_or_found(F.col("reply_count"), F.col("n_replies")).alias("reply_count"),
        "n_replies",
    )


def declared_or_found(declared: Column, found: Column) -> Column:
    """The declared reply count, or the number found when none is declared."""
    return F.when(F.coalesce(declared, F.lit(0)) != 0, declared).otherwise(found).cast("int")


def limit_depth(replies: DataFrame, max_depth: int) -> DataFrame:
    """First ``max_depth`` replies of each thread by position.

    The group limit runs before the exchange, so no task sees more than
    ``max_depth`` rows per thread and map task.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*_THREAD).orderBy("pos"))
    return replies.withColumn("_rank", rank).filter(F.col("_rank") <= max_depth).drop("_rank")
