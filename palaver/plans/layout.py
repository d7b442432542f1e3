"""Ordered text blocks of an export.

A document is a table of text blocks with a total sort key, never one string: a
sink sorts it by range over the cluster, and joining the blocks with newlines gives
the whole document. Hot channels, months and threads are simply more blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import jsontext, render
from palaver.functions.text import html_escape, json_quote
from palaver.operators import summary, threads
from palaver.plans.export import Export, stored

SORT_KEY = ("month", "channel_pos", "channel", "section", "thread_ts", "tie", "pos")

_EXPORT_HEAD, _CHANNEL_HEAD, _THREADS, _MIDDLE, _STANDALONE, _CHANNEL_TAIL, _EXPORT_TAIL = range(7)
_FIRST, _LAST = -1, 2**31 - 1
_BUCKET = ["month", "channel"]


@dataclass(frozen=True)
class Layout:
    """``rows``: one per message of the export; ``heads``: one per month and channel; ``documents``: one per file."""

    rows: DataFrame
    heads: DataFrame
    documents: DataFrame
    split_by: str | None


def lay_out(export: Export, split_by: str | None = None) -> Layout:
    """Place every message in its document. Without a split the month is empty."""
    if split_by not in (None, "month"):
        raise ValueError(f"unknown split {split_by!r}")
    top = export.messages
    top = export.with_month(top) if split_by else top.withColumn("month", F.lit(""))
    top = top.withColumn("is_parent", F.coalesce("reply_count", F.lit(0)) > 0 if export.expand_threads else F.lit(False))

    # Ids are unique per channel; search hits of several channels need a further key.
    tie = F.lit("")
    if "source_channel" in top.columns:
        tie = F.concat_ws("/", "source_channel", F.lpad(F.col("seq").cast("string"), 20, "0"))
    top = top.withColumn("tie", tie)

    found = threads.reply_totals(export.reply_source)
    placed = (
        top.withColumn("parent_ts", F.col("timestamp"))
        .join(found, ["channel", "parent_ts"], "left")
        .withColumn("n_replies", F.coalesce("n_replies", F.lit(0)))
    )
    message = threads.message_struct().alias("m")
    top_rows = placed.select(
        *_BUCKET,
        F.when(F.col("is_parent"), _THREADS).otherwise(_STANDALONE).alias("section"),
        F.col("timestamp").alias("thread_ts"),
        "tie",
        F.lit(_FIRST).alias("pos"),
        "last_pos",
        "n_replies",
        "reply_count",
        message,
    )
    anchors = placed.filter("is_parent").select("channel", "parent_ts", "month", "last_pos", "n_replies", "reply_count")
    reply_rows = export.reply_source.join(anchors, ["channel", "parent_ts"]).select(
        *_BUCKET,
        F.lit(_THREADS).alias("section"),
        F.col("parent_ts").alias("thread_ts"),
        F.lit("").alias("tie"),
        "pos",
        "last_pos",
        "n_replies",
        "reply_count",
        message,
    )

    totals = summary.month_totals(
        top,
        export.expand_threads,
        F.max(F.when(F.col("is_parent"), F.col("timestamp"))).alias("last_thread"),
        F.max(F.when(~F.col("is_parent"), F.struct("timestamp", "tie"))).alias("last_standalone"),
    )
    if export.all_messages is not None:  # totals count threads that are left out, too
        everything = export.with_month(export.counted) if split_by else export.counted.withColumn("month", F.lit(""))
        counts = everything.groupBy("month", "channel").agg(F.count(F.lit(1)).alias("total_messages"))
        totals = counts.join(totals.drop("total_messages"), ["month", "channel"], "left").fillna(0, ["n_threads", "n_standalone"])
    heads = summary.attach_channels(totals, export.channels, keep_empty=not split_by)
    heads = heads.withColumn("month", F.coalesce("month", F.lit(""))).withColumn(
        "channel_pos", F.coalesce("channel_pos", F.lit(0))
    )
    if export.store:
        # Read several times below; as a file its size is known, so Spark can judge a broadcast.
        heads = stored(heads, "heads")
    return Layout(top_rows.unionByName(reply_rows), heads, _documents(heads, split_by), split_by)


def _documents(heads: DataFrame, split_by: str | None) -> DataFrame:
    """``month, n_channels, leading, last_channel``; an unsplit export is a document even without channels."""
    order = Window.partitionBy("month").orderBy("channel_pos", "channel")
    ranked = heads.withColumn("_rank", F.row_number().over(order))
    first_three = F.collect_list(F.when(F.col("_rank") <= 3, F.struct("_rank", "channel")))
    documents = ranked.groupBy("month").agg(
        F.transform(F.sort_array(first_three), lambda s: s["channel"]).alias("leading"),
        F.count(F.lit(1)).alias("n_channels"),
        F.max(F.struct("channel_pos", "channel")).alias("last_channel"),
    )
    if not split_by:
        only = heads.sparkSession.range(1).select(F.lit("").alias("month"))
        documents = only.join(documents, "month", "left").fillna(0, "n_channels")
    return documents


def stems(documents: DataFrame, template: str = "{channel}_{date}", date: str = "", suffix: str = "") -> DataFrame:
    """File name per document: first three channels, ``_+N`` for the rest, ``export`` if there are none.

    The date is the month in a split export. Characters unsafe in paths become ``_``.
    """
    rest = F.col("n_channels") - 3
    more = F.when(rest > 0, F.concat(F.lit("_+"), rest.cast("string"))).otherwise("")
    channel = F.concat(F.coalesce(F.array_join("leading", "_"), F.lit("")), more)
    return documents.select("month", file_name(channel, template, date, suffix).alias("stem"))


def file_name(channel: Column, template: str, date: str, suffix: str) -> Column:
    channel = F.when(channel == "", F.lit("export")).otherwise(channel)
    day = F.when(F.col("month") == "", F.lit(date)).otherwise(F.col("month"))
    name = F.replace(F.replace(F.lit(template), F.lit("{channel}"), channel), F.lit("{date}"), day)
    name = F.when(F.endswith(name, F.lit(suffix)), name).otherwise(F.concat(name, F.lit(suffix)))
    return F.regexp_replace(name, r"[^\w.+-]", "_")


def markdown_blocks(export: Export, layout: Layout, title: str = "Export") -> DataFrame:
    """Rows ``SORT_KEY + text``."""
    heads = layout.heads
    head_text = F.concat(
        F.lit(f"# {title} — {export.workspace}\n*Exported: {export.export_date}*\n")
    )
    export_head = _edges(layout.documents, _EXPORT_HEAD, _FIRST, head_text)
    channel_head = _from_heads(
        heads,
        _CHANNEL_HEAD,
        F.concat(
            F.lit("## #"),
            F.col("channel"),
            F.lit("\n*"),
            F.col("total_messages").cast("string"),
            F.lit(" messages | Status: "),
            F.col("status"),
            F.lit("*\n"),
        ),
    )
    other = _from_heads(
        heads.filter((F.col("n_threads") > 0) & (F.col("n_standalone") > 0)),
        _MIDDLE,
        F.lit(render.OTHER_HEADING + "\n"),
    )
    m = F.col("m")
    is_parent_row = F.col("pos") == _FIRST
    body = F.when(
        is_parent_row,
        F.concat(
            render.message(m),
            F.when(
                (F.col("section") == _THREADS) & (F.col("n_replies") > 0),
                F.concat(F.lit("\n"), render.replies_line(F.col("n_replies"))),
            ).otherwise(""),
        ),
    ).otherwise(render.message(m, render.REPLY_INDENT))
    closing = F.when((F.col("section") == _STANDALONE) | _ends_thread(), F.lit(f"\n{render.RULE}\n")).otherwise("")
    content = _with_position(layout.rows, heads).select(*SORT_KEY, F.concat(body, closing).alias("text"))
    return export_head.unionByName(channel_head).unionByName(content).unionByName(other)


def html_blocks(export: Export, layout: Layout, title: str = "Export") -> DataFrame:
    """Blocks of a static page per document; a thread is an article with its replies quoted."""
    named, workspace, date = (html_escape(F.lit(v)) for v in (title, export.workspace, export.export_date))
    opening = F.concat(
        F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), named, F.lit("</title></head><body>\n<h1>"),
        named, F.lit(" — "), workspace, F.lit("</h1><p>Exported: "), date, F.lit("</p>"),
    )
    channel = F.concat(
        F.lit("<section><h2>#"), html_escape(F.col("channel")), F.lit("</h2><p>"), F.col("total_messages").cast("string"),
        F.lit(" messages | Status: "), html_escape(F.col("status")), F.lit("</p>"),
    )
    text = render.html_message(F.col("m"))
    start = F.concat(F.lit('<article id="'), html_escape(F.col("thread_ts")), F.lit('">'))
    body = F.when(F.col("pos") == _FIRST, F.concat(start, text)).otherwise(
        F.concat(F.lit("<blockquote>"), text, F.lit("</blockquote>"))
    )
    closing = F.when((F.col("section") == _STANDALONE) | _ends_thread(), F.lit("</article>")).otherwise("")
    blocks = _edges(layout.documents, _EXPORT_HEAD, _FIRST, opening)
    for part in (
        _from_heads(layout.heads, _CHANNEL_HEAD, channel),
        _with_position(layout.rows, layout.heads).select(*SORT_KEY, F.concat(body, closing).alias("text")),
        _from_heads(layout.heads, _CHANNEL_TAIL, F.lit("</section>")),
        _edges(layout.documents, _EXPORT_TAIL, _LAST, F.lit("</body></html>")),
    ):
        blocks = blocks.unionByName(part)
    return blocks


def plain_blocks(export: Export, layout: Layout, title: str = "Export") -> DataFrame:
    """Plain text: a line per message, replies indented below their parent."""
    opening = F.lit(f"{title} - {export.workspace} - {export.export_date}")
    channel = F.concat(F.lit("#"), F.col("channel"), F.lit(" ("), F.col("total_messages").cast("string"), F.lit(" messages)"))
    m = F.col("m")
    line = F.when(F.col("pos") == _FIRST, render.plain_message(m)).otherwise(render.plain_message(m, "    "))
    return (
        _edges(layout.documents, _EXPORT_HEAD, _FIRST, opening)
        .unionByName(_from_heads(layout.heads, _CHANNEL_HEAD, channel))
        .unionByName(_with_position(layout.rows, layout.heads).select(*SORT_KEY, line.alias("text")))
    )


def _ends_thread() -> Column:
    """The row closes its thread: the last reply, or a parent without replies."""
    return F.when(F.col("pos") == _FIRST, F.col("n_replies") == 0).otherwise(F.col("pos") == F.col("last_pos"))


def json_blocks(export: Export, layout: Layout) -> DataFrame:
    """Blocks of the nested JSON document (two spaces per level), rows ``SORT_KEY + text``."""
    heads = layout.heads.join(layout.documents.select("month", "last_channel"), "month").withColumn(
        "_comma", F.when(F.struct("channel_pos", "channel") == F.col("last_channel"), F.lit("")).otherwise(",")
    )
    members = [
        ("workspace", export.workspace),
        ("export_date", export.export_date),
        ("format_version", export.format_version),
    ]
    opening = F.concat(
        F.lit("{\n"),
        jsontext.lines([F.concat(F.lit(f'  "{k}": '), json_quote(F.lit(v))) for k, v in members]),
        F.when(F.col("n_channels") > 0, F.lit(',\n  "channels": [')).otherwise(',\n  "channels": []\n}'),
    )
    export_head = _edges(layout.documents, _EXPORT_HEAD, _FIRST, opening)
    export_tail = _edges(layout.documents.filter("n_channels > 0"), _EXPORT_TAIL, _LAST, F.lit("  ]\n}"))
    channel_members = [("channel", "channel"), ("status", "status")] + [
        (name, name) for name in ("export_started", "export_finished")
    ]
    channel_head = _from_heads(
        heads,
        _CHANNEL_HEAD,
        F.concat(
            F.lit("    {\n"),
            jsontext.lines(
                [F.concat(F.lit(f'      "{k}": '), json_quote(F.coalesce(F.col(c), F.lit("")))) for k, c in channel_members]
                + [F.concat(F.lit('      "total_messages": '), F.col("total_messages").cast("string"))]
            ),
            F.when(F.col("n_threads") > 0, F.lit(',\n      "threads": [')).otherwise(',\n      "threads": [],'),
        ),
    )
    middle = _from_heads(
        heads,
        _MIDDLE,
        F.concat(
            F.when(F.col("n_threads") > 0, F.lit("      ],\n")).otherwise(""),
            F.when(F.col("n_standalone") > 0, F.lit('      "standalone_messages": [')).otherwise(
                F.concat(F.lit('      "standalone_messages": []\n    }'), F.col("_comma"))
            ),
        ),
    )
    channel_tail = _from_heads(
        heads.filter("n_standalone > 0"), _CHANNEL_TAIL, F.concat(F.lit("      ]\n    }"), F.col("_comma"))
    )

    rows = _with_position(layout.rows, heads, "last_thread", "last_standalone")
    m = F.col("m")

    def comma(is_last: Column) -> Column:
        return F.when(is_last, F.lit("")).otherwise(",")

    count = threads.declared_or_found(F.col("reply_count"), F.col("n_replies")).cast("string")
    thread_end = F.concat(
        F.lit('          "reply_count": '), count, F.lit("\n        }"), comma(F.col("thread_ts") == F.col("last_thread"))
    )
    parent = F.concat(
        F.lit('        {\n          "parent": {\n'),
        jsontext.message(m, 12),
        F.lit("\n          },\n"),
        F.when(F.col("n_replies") > 0, F.lit('          "replies": [')).otherwise(
            F.concat(F.lit('          "replies": [],\n'), thread_end)
        ),
    )
    ends_here = F.col("pos") == F.col("last_pos")
    reply = F.concat(
        F.lit("            {\n"),
        jsontext.message(m, 14),
        F.lit("\n            }"),
        comma(ends_here),
        F.when(ends_here, F.concat(F.lit("\n          ],\n"), thread_end)).otherwise(""),
    )
    single = F.concat(
        F.lit("        {\n"),
        jsontext.message(m, 10),
        F.lit("\n        }"),
        comma(F.struct(F.col("thread_ts").alias("timestamp"), "tie") == F.col("last_standalone")),
    )
    text = F.when(F.col("section") == _STANDALONE, single).when(F.col("pos") == _FIRST, parent).otherwise(reply)
    content = rows.select(*SORT_KEY, text.alias("text"))
    blocks = export_head
    for part in (channel_head, content, middle, channel_tail, export_tail):
        blocks = blocks.unionByName(part)
    return blocks


def _with_position(rows: DataFrame, heads: DataFrame, *extra: str) -> DataFrame:
    """Attach channel order to message rows; ``heads`` has one row per month and channel."""
    return rows.join(heads.select(*_BUCKET, "channel_pos", *extra), _BUCKET)


def _from_heads(heads: DataFrame, section: int, text: Column) -> DataFrame:
    return heads.select(
        "month",
        "channel_pos",
        "channel",
        F.lit(section).alias("section"),
        F.lit("").alias("thread_ts"),
        F.lit("").alias("tie"),
        F.lit(_FIRST).alias("pos"),
        text.alias("text"),
    )


def _edges(documents: DataFrame, section: int, channel_pos: int, text: Column) -> DataFrame:
    """One block per document, before or after all channels."""
    return documents.select(
        "month",
        F.lit(channel_pos).alias("channel_pos"),
        F.lit("").alias("channel"),
        F.lit(section).alias("section"),
        F.lit("").alias("thread_ts"),
        F.lit("").alias("tie"),
        F.lit(_FIRST).alias("pos"),
        text.alias("text"),
    )
