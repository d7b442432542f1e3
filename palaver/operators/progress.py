"""Progress of incremental runs: high-water marks, what is done, what is left.

Progress is a table with one row per ``(export_id, channel)``, appended to on every
save; expanded threads are a long table of their own, so no row grows with the data.
Joins carry no broadcast hint: Spark broadcasts the progress side while it is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles and splits hot channels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators import clean

COMPLETED = "completed"
_THREAD = ["channel", "parent_ts"]


def high_water(messages: DataFrame) -> DataFrame:
    """Largest id (string order) and message count per channel."""
    return messages.groupBy("channel").agg(
        F.max("timestamp").alias("last_message_ts"), F.count(F.lit(1)).alias("message_count")
    )


def progress_rows(
    messages: DataFrame, export_id: Column, status: Column, updated_at: Column, workspace_url: str = "", fmt: str = "json"
) -> DataFrame:
    """Progress as the data shows it, for appending to the progress table.

    ``export_id``, ``status`` and ``updated_at`` are columns over the per-run,
    per-channel aggregate (``channel, last_message_ts, message_count``) or literals.
    """
    per_channel = messages.groupBy(export_id.alias("export_id"), "channel").agg(
        F.max("timestamp").alias("last_message_ts"), F.count(F.lit(1)).alias("message_count")
    )
    return per_channel.select(
        "export_id",
        F.lit(workspace_url).alias("workspace_url"),
        "channel",
        status.alias("status"),
        "last_message_ts",
        "message_count",
        F.lit(None).cast("string").alias("search_query"),
        updated_at.alias("created_at"),
        updated_at.alias("updated_at"),
        F.lit(fmt).alias("format"),
    )


def latest(progress: DataFrame) -> DataFrame:
    """Newest saved row per run and channel. Saves are appended, never rewritten."""
    return clean.first_seen(
        progress,
        ("export_id", "channel"),
        (F.desc("updated_at"), F.desc("message_count"), F.desc("last_message_ts")),
    )


def newest(progress: DataFrame, export_id: str | None = None) -> DataFrame:
    """The newest row per run and channel, of one run if it is named."""
    rows = progress if export_id is None else for_run(progress, export_id)
    return latest(rows) if "updated_at" in rows.columns else rows


def for_run(progress: DataFrame, export_id: str) -> DataFrame:
    """One run's progress; raises ``LookupError`` when there is none."""
    rows = progress.filter(F.col("export_id") == export_id)
    if rows.isEmpty():
        raise LookupError(f"no progress saved for run {export_id!r}")
    return rows


def after_high_water(messages: DataFrame, progress: DataFrame) -> DataFrame:
    """Keep ids above the saved mark, in string order. Older unseen history is lost: see :func:`not_exported`."""
    marks = progress.groupBy("channel").agg(F.max("last_message_ts").alias("_mark"))
    joined = messages.join(marks, "channel", "left")
    keep = F.col("_mark").isNull() | (F.col("_mark") == "") | (F.col("timestamp") > F.col("_mark"))
    return joined.filter(keep).drop("_mark")


def not_exported(messages: DataFrame, exported: DataFrame) -> DataFrame:
    """Lossless resume: messages whose ``(channel, timestamp)`` is not among the exported ones."""
    return messages.join(exported.select("channel", "timestamp"), ["channel", "timestamp"], "left_anti")


def skip_completed(df: DataFrame, progress: DataFrame) -> DataFrame:
    done = progress.filter(F.col("status") == COMPLETED).select("channel")
    return df.join(done, "channel", "left_anti")


def skip_expanded(parents: DataFrame, expanded: DataFrame) -> DataFrame:
    done = expanded.select("channel", F.col("parent_ts").alias("timestamp"))
    return parents.join(done, ["channel", "timestamp"], "left_anti")


def add_expanded(expanded: DataFrame, parents: DataFrame, export_id: str) -> DataFrame:
    """Set union of expanded thread ids; marking a thread twice keeps one row."""
    new = parents.select(
        F.lit(export_id).alias("export_id"), "channel", F.col("timestamp").alias("parent_ts")
    )
    return expanded.select("export_id", *_THREAD).unionByName(new).distinct()


def status(progress: DataFrame, updated_chars: int | None = None) -> DataFrame:
    """One row per run, newest first: ``completed/total completed``. Finished runs are listed too.

    Repeated saves of a channel count once. ``updated_chars`` shortens the time for a listing.
    """
    updated = F.col("updated_at") if updated_chars is None else F.substring("updated_at", 1, updated_chars)
    per_run = latest(progress).groupBy("export_id").agg(
        F.max_by("workspace_url", F.struct("updated_at", "workspace_url")).alias("workspace"),
        F.count_if(F.col("status") == COMPLETED).alias("_done"),
        F.count("channel").alias("_total"),
        F.max("updated_at").alias("updated_at"),
        F.max_by("search_query", F.struct("updated_at", "search_query")).alias("search_query"),
    )
    return per_run.orderBy(F.desc("updated_at"), "export_id").select(
        "export_id",
        "workspace",
        F.format_string("%d/%d completed", "_done", "_total").alias("channels"),
        (F.col("_done") == F.col("_total")).alias("is_complete"),
        updated.alias("updated"),
        "search_query",
    )
