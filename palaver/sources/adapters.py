"""The test tables seen as chat tables.

Ids are epoch microseconds as strings; the session zone must be UTC. ``overlap``
adds every row a second time with altered text and a later ``seq``, as overlapping
reads of a channel would; the first copy must win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions import html as h
from palaver.functions.text import html_escape as escape
from palaver.operators import clean, threads
from palaver.schema import as_messages, as_replies

# Order dates lie before the first 16-digit instant; a shift of 15 years in days puts them after it.
ORDER_SHIFT = 5479 * 86_400_000_000
CONVERSATION_START = 1_704_067_200
MINUTE, DAY = 60, 86_400
PAGE_TURNS = 50


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def messages_from_events(events: DataFrame, overlap: bool = False) -> DataFrame:
    """Channel = event type, user = ``u<user_id>``; every tenth user is a bot."""

    def copy(seq: Column, text: Column) -> DataFrame:
        return as_messages(
            events,
            channel=F.col("event_type"),
            seq=seq,
            user=F.concat(F.lit("u"), F.col("user_id")),
            text=text,
            timestamp=micros(F.col("ts")).cast("string"),
            is_bot=F.col("user_id") % 10 == 0,
        )

    first = copy(2 * F.col("event_id"), F.col("props"))
    if not overlap:
        return first
    return first.unionByName(copy(2 * F.col("event_id") + 1, F.upper("props")))


def threads_from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One thread per conversation, turn 0 its parent; one conversation a day, one turn a minute."""
    found = replies_from_conversations(conversations)
    top = as_messages(
        conversations.filter("turn = 0"), seq=F.col("conv_id") * 1000 + F.col("turn"), **_turn_columns()
    )
    return threads.with_reply_counts(top, found), found


def replies_from_conversations(conversations: DataFrame) -> DataFrame:
    parent_stamp = (F.lit(CONVERSATION_START) + F.col("conv_id") * DAY) * 1_000_000
    return as_replies(
        conversations.filter("turn > 0"), parent_ts=parent_stamp.cast("string"), pos=F.col("turn"), **_turn_columns()
    )


def _turn_columns() -> dict[str, Column]:
    stamp = (F.lit(CONVERSATION_START) + F.col("conv_id") * DAY + F.col("turn") * MINUTE) * 1_000_000
    return {
        "channel": F.lit("conversations"),
        "user": F.col("role"),
        "text": F.col("text"),
        "timestamp": stamp.cast("string"),
        "is_bot": F.col("role") == "assistant",
    }


def threads_from_orders(orders: DataFrame, lineitem: DataFrame, shift: int = ORDER_SHIFT) -> tuple[DataFrame, DataFrame]:
    """Orders as messages of the priority's channel, first line per line number as replies.

    Without the shift all ids have 15 digits and are undated.
    """
    stamp = (micros(F.col("o_orderdate")) + shift + F.col("o_orderkey")).cast("string")
    # Dealt by order, the lines are made distinct, counted and joined with their order without a further exchange.
    lines = lineitem.repartition("l_orderkey")
    found = as_replies(
        first_lines(lines).join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", stamp.alias("parent_ts")), "l_orderkey"),
        channel=F.col("o_orderpriority"),
        parent_ts=F.col("parent_ts"),
        pos=F.col("l_linenumber"),
        user=F.concat(F.lit("s"), F.col("l_suppkey")),
        text=F.col("l_partkey"),
        timestamp=(micros(F.col("l_shipdate")) + shift).cast("string"),
        is_bot=F.col("l_linestatus") == "F",
    )
    # The count of a thread is the sum over the orders of its id: the numbers of lines suffice, not the lines.
    counts = lines.select("l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_n"))
    counted = orders.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("_id", stamp)
    top = as_messages(
        counted.withColumn("_n", F.sum("_n").over(Window.partitionBy("o_orderpriority", "_id"))),
        channel=F.col("o_orderpriority"),
        seq=F.col("o_orderkey"),
        user=F.concat(F.lit("c"), F.col("o_custkey")),
        text=F.col("o_orderstatus"),
        timestamp=F.col("_id"),
        is_bot=F.col("o_orderstatus") == "P",
        reply_count=F.when(F.col("o_orderpriority").isNotNull() & F.col("_id").isNotNull(), F.coalesce("_n", F.lit(0))).otherwise(0),
    )
    return top, found


def first_lines(lineitem: DataFrame) -> DataFrame:
    """One row per order and line number, first in a total order."""
    order = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return clean.first_seen(lineitem, ("l_orderkey", "l_linenumber"), order)


def messages_from_documents(documents: DataFrame) -> DataFrame:
    """Channel = source, user = language, one document a minute."""
    return as_messages(
        documents,
        channel=F.col("source"),
        seq=F.col("doc_id"),
        user=F.col("lang"),
        text=F.col("text"),
        timestamp=((F.lit(CONVERSATION_START) + F.col("doc_id") * MINUTE) * 1_000_000).cast("string"),
    )


def snapshots_from_conversations(conversations: DataFrame) -> DataFrame:
    """Saved pages of some turns each, all read twice; the second read has other text."""
    page_number = F.shiftleft(F.col("conv_id"), 12).bitwiseOR(F.col("page"))

    def page(seq: Column, text: Column) -> DataFrame:
        item = item_html(
            user=F.col("role"),
            text=text,
            message_id=((F.lit(CONVERSATION_START) + F.col("conv_id") * DAY + F.col("turn") * MINUTE) * 1_000_000),
            label=F.concat(F.lit("Turn "), F.col("turn")),
            is_bot=F.col("role") == "assistant",
            reply_count=F.col("turn"),
        )
        items = F.sort_array(F.collect_list(F.struct("turn", item.alias("item"))))
        return conversations.groupBy("conv_id", (F.col("turn") / PAGE_TURNS).cast("bigint").alias("page")).agg(
            items.alias("items")
        ).select(
            F.lit("conversations").alias("channel"),
            seq.alias("snapshot_seq"),
            F.timestamp_seconds(F.lit(CONVERSATION_START) + F.col("conv_id") * DAY).alias("captured_at"),
            F.concat(
                F.lit("<html><body>"), F.array_join(F.transform("items", lambda i: i["item"]), "\n"), F.lit("</body></html>")
            ).alias("html"),
        )

    return page(2 * page_number, F.col("text")).unionByName(
        page(2 * page_number + 1, F.concat(F.lit("edited "), F.col("text")))
    )


def panels_from_conversations(conversations: DataFrame) -> DataFrame:
    """Saved thread panels of some turns each, the first item of a conversation being the parent."""
    item = item_html(
        user=F.col("role"),
        text=F.col("text"),
        message_id=(F.lit(CONVERSATION_START) + F.col("conv_id") * DAY + F.col("turn") * MINUTE) * 1_000_000,
        label=F.concat(F.lit("Turn "), F.col("turn")),
        is_bot=F.col("role") == "assistant",
        reply_count=F.lit(0),
    )
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", item.alias("item")))), lambda i: i["item"])
    pages = conversations.groupBy("conv_id", (F.col("turn") / PAGE_TURNS).cast("bigint").alias("page"))
    return pages.agg(F.array_join(listed, "\n").alias("html"), F.min("turn").alias("first_pos")).select(
        F.lit("conversations").alias("channel"),
        ((F.lit(CONVERSATION_START) + F.col("conv_id") * DAY) * 1_000_000).cast("string").alias("parent_ts"),
        "first_pos",
        "html",
    )


def item_html(user: Column, text: Column, message_id: Column, label: Column, is_bot: Column, reply_count: Column) -> Column:
    """A message list item carrying the markers of :mod:`palaver.functions.html`."""
    return F.concat(
        F.lit(f'<div class="row" data-qa="{h.ITEM}"><span data-qa="{h.SENDER}"><b> '),
        escape(user),
        F.lit("\xa0</b></span>"),
        F.when(is_bot, F.lit(f'<i data-qa="{h.BOT_LABEL}">APP</i>')).otherwise(""),
        F.lit(f'<a class="x {h.STAMP[1:]} y" aria-label="'),
        label,
        F.lit('" href="/archives/C1/p'),
        message_id.cast("string"),
        F.lit(f'">t</a><span data-qa="{h.TEXT}">'),
        F.replace(escape(text), F.lit("\n"), F.lit("<br/>")),
        F.lit("</span>"),
        F.when(
            reply_count > 0,
            F.concat(F.lit(f'<button data-qa="{h.REPLY_COUNT}">'), reply_count.cast("string"), F.lit(" replies</button>")),
        ).otherwise(""),
        F.lit(f'<button data-qa="{h.REACTION_ITEM}" aria-label="'),
        (reply_count + 2).cast("string"),
        F.lit(' reactions, react with fire emoji">f</button>'),
        F.lit(f'<button aria-label="react with tada" data-qa="{h.REACTION_ITEM}">t</button>'),
        F.lit(f'<span data-qa="{h.FILE}">file of '),
        escape(user),
        F.lit("</span></div>"),
    )


def catalog_from_nation(nation: DataFrame, region: DataFrame) -> DataFrame:
    """Regions as sections, nations as channels; a later section repeats all channels, one more is empty."""
    listed = (
        region.join(nation, region.r_regionkey == nation.n_regionkey, "left")
        .groupBy(F.col("r_regionkey").alias("seq"), F.col("r_name").alias("section"))
        .agg(F.sort_array(F.collect_list("n_name")).alias("channels"))
    )
    repeated = listed.select((F.col("seq") + 1000).alias("seq"), F.lit("ALL").alias("section"), "channels")
    empty = region.select(
        (F.col("r_regionkey") + 2000).alias("seq"), F.lit("EMPTY").alias("section"), F.array().cast("array<string>").alias("channels")
    )
    return listed.unionByName(repeated).unionByName(empty)


def sidebars_from_nation(nation: DataFrame, region: DataFrame) -> DataFrame:
    """A saved sidebar per region; only sections whose name starts with A carry a label."""
    channel = F.concat(F.lit(f'<span data-qa="{h.CHANNEL_PREFIX}'), escape(F.col("n_name")), F.lit('">n</span>'))
    return (
        region.join(nation, region.r_regionkey == nation.n_regionkey, "left")
        .groupBy("r_regionkey", "r_name")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", channel.alias("c")))), lambda s: s["c"]), "").alias("items"))
        .select(
            F.col("r_regionkey").cast("bigint").alias("seq"),
            F.concat(
                F.lit(f'<div><button data-qa="{h.SECTION}">'),
                F.when(
                    F.col("r_name").like("A%"),
                    F.concat(F.lit(f'<span class="{h.SECTION_LABEL[1:]}"> '), escape(F.col("r_name")), F.lit(" </span>")),
                ).otherwise(""),
                F.lit("</button>"),
                "items",
                F.lit("</div>"),
            ).alias("html"),
        )
    )
