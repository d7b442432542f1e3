"""Channel and search exports as one declarative plan each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.operators import clean, progress as progress_ops, summary, threads
from palaver.session import shared_folder
from palaver.schema import CHANNELS, FORMAT_VERSION, REPLIES

SEARCH_NAME_CUT = 20


@dataclass(frozen=True)
class Export:
    """Tables of one export run.

    ``messages`` are the surviving top-level messages, ``reply_source`` the long table
    that holds their replies, ``channels`` the requested channels with their run metadata.
    ``reply_source`` may hold replies of other messages too: nesting and documents join
    it with the parents anyway, so only :attr:`replies` pays for a join of its own.
    ``store`` tells that the tables are written copies and intermediate ones may be too.
    """

    messages: DataFrame
    reply_source: DataFrame
    channels: DataFrame
    workspace: str = ""
    export_date: str = ""
    format_version: str = FORMAT_VERSION
    expand_threads: bool = True
    store: bool = False
    all_messages: DataFrame | None = None
    captured_at: str | None = None

    @property
    def counted(self) -> DataFrame:
        """The messages that totals count: all of them, also where threads already saved are left out."""
        return self.messages if self.all_messages is None else self.all_messages

    def with_month(self, rows: DataFrame) -> DataFrame:
        """Month of each row, labels without a date read with the capture time where rows carry it."""
        return summary.with_month(rows, self.captured_at if self.captured_at in rows.columns else None)

    @property
    def parents(self) -> DataFrame:
        return threads.parents(self.messages) if self.expand_threads else self.messages.filter(F.lit(False))

    @property
    def replies(self) -> DataFrame:
        return threads.thread_replies(self.reply_source, self.parents)

    @property
    def standalone(self) -> DataFrame:
        return threads.standalone(self.messages, self.expand_threads)

    def nested_threads(self, page_size: int = threads.PAGE_SIZE) -> DataFrame:
        return threads.nest(self.parents, self.reply_source, page_size)

    def without_expanded(self, expanded: DataFrame) -> Export:
        """The rest of a resumed run: threads whose replies are already saved are left out whole.

        Only parents are: a message once expanded that is standalone now stays, and totals count everything.
        """
        if not self.expand_threads:
            return self
        rest = self.standalone.unionByName(progress_ops.skip_expanded(self.parents, expanded))
        return replace(self, messages=rest, all_messages=self.counted)

    def dated(self, workspace: str, export_date: str) -> Export:
        return replace(self, workspace=workspace, export_date=export_date)


def channel_table(spark, channels: Sequence[str], status: str = "completed", started: str = "", finished: str = "") -> DataFrame:
    """Requested channels in request order, with the run metadata of each."""
    rows = [(name, pos, status, started, finished) for pos, name in enumerate(channels)]
    return spark.createDataFrame(rows, CHANNELS)


def channels_found(messages: DataFrame, status: str = "completed", started: str = "", finished: str = "") -> DataFrame:
    """Channel metadata when no list is requested: every channel present, in name order."""
    return messages.select("channel").distinct().select(
        "channel",
        F.lit(0).alias("channel_pos"),
        F.lit(status).alias("status"),
        F.lit(started).alias("export_started"),
        F.lit(finished).alias("export_finished"),
    )


def clean_messages(
    messages: DataFrame,
    channels: Sequence[str] | DataFrame | None = None,
    oldest: str | None = None,
    newest: str | None = None,
    exclude_bots: bool = False,
    captured_at: str | None = None,
    stored_month: str | None = None,
) -> DataFrame:
    """Selected channels, first-seen distinct, then the filters.

    The distinct comes first by rule: when the first copy of a message is filtered
    out, later copies do not take its place. ``stored_month`` names the partition
    column of a table stored by the month of the id, whose other months are not read.
    """
    if stored_month:
        messages = clean.stored_months(messages, stored_month, oldest, newest)
    selected = clean.with_ids(clean.select_channels(messages, channels))
    kept = clean.date_bounds(clean.first_seen(selected), oldest, newest, captured_at)
    return clean.exclude_bots(kept) if exclude_bots else kept


def channel_export(
    messages: DataFrame,
    replies: DataFrame,
    channels: Sequence[str] | DataFrame | None = None,
    oldest: str | None = None,
    newest: str | None = None,
    exclude_bots: bool = False,
    expand_threads: bool = True,
    progress: DataFrame | None = None,
    exported: DataFrame | None = None,
    mode: str = "anti_join",
    export_id: str | None = None,
    captured_at: str | None = None,
    stored_month: str | None = None,
    store: bool = False,
) -> Export:
    """Export of the requested channels (all when none are named, a table of names in name order).

    ``store`` writes the cleaned messages and their replies once to the shared folder.
    Sinks that render documents read them several times, each time other columns. In an export of everything
    the stored replies may include some of other messages.

    ``export_id`` names the run that ``progress`` is read for (all its runs when not given);
    of repeated saves the newest counts. With ``progress`` completed channels are left out and the rest is resumed:
    ``mode="anti_join"`` keeps everything not in ``exported``, ``mode="high_water"``
    keeps ids above the saved mark and so loses older history not yet read.
    """
    if mode not in ("anti_join", "high_water"):
        raise ValueError(f"unknown resume mode {mode!r}")
    source = messages
    if progress is not None:
        progress = progress_ops.newest(progress, export_id)
        source = progress_ops.skip_completed(source, progress)
        if mode == "high_water":
            source = progress_ops.after_high_water(source, progress)
    if exported is not None and mode == "anti_join":
        source = progress_ops.not_exported(source, exported)
    kept = clean_messages(source, channels, oldest, newest, exclude_bots, captured_at, stored_month)
    if store:
        kept = stored(kept, "messages")
    if not expand_threads:
        found = replies.filter(F.lit(False))
    else:
        found = clean.exclude_bots(replies) if exclude_bots else replies
        if store:
            # Whoever reads replies joins them with their parents, so a join before is worth its exchange only if it drops many.
            narrowed = channels is not None or progress is not None or exported is not None or oldest or newest
            found = stored(threads.thread_replies(found, threads.parents(kept)) if narrowed else found, "replies")
    if isinstance(channels, DataFrame):
        meta = channels_found(channels)
    else:
        meta = channel_table(messages.sparkSession, channels) if channels else channels_found(kept)
    return Export(kept, found, meta, expand_threads=expand_threads, store=store, captured_at=captured_at)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and go on from the written copy."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def search_export(
    messages: DataFrame,
    query: str,
    oldest: str | None = None,
    newest: str | None = None,
    exclude_bots: bool = False,
) -> Export:
    """Keyword hits as one pseudo-channel ``search_<query>``, all standalone.

    ``source_channel`` keeps where a hit came from. Hits carry no threads.
    """
    hits = clean.first_hits(messages.filter(clean.keyword_match(F.col("text"), query)))
    hits = clean.date_bounds(hits, oldest, newest)
    if exclude_bots:
        hits = clean.exclude_bots(hits)
    name = search_name(query)
    hits = hits.withColumn("source_channel", F.col("channel")).withColumn("channel", F.lit(name))
    spark = messages.sparkSession
    no_replies = spark.createDataFrame([], REPLIES)
    return Export(hits, no_replies, channel_table(spark, [name]), expand_threads=False)


def search_name(query: str) -> str:
    return f"search_{query[:SEARCH_NAME_CUT]}"


def in_search_order(hits: DataFrame) -> DataFrame:
    return hits.orderBy("timestamp", "source_channel", "seq")


def require_scope(channels: Sequence[str] | None, query: str | None, export_id: str | None) -> None:
    """A run needs channels, a search query or a run to resume."""
    if not (channels or query or export_id):
        raise ValueError("name channels, a search query or a run to resume")
