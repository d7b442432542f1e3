"""An export run from saved progress to appended progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators import progress as progress_ops
from palaver.operators import threads
from palaver.plans.export import Export, channel_export, require_scope
from palaver.schema import EXPANDED, EXPORTED, PROGRESS
from palaver.sinks import rows, text

WRITERS = {"markdown": text.write_markdown, "json": text.write_json, "html": text.write_html, "text": text.write_plain}


def run_export(
    messages: DataFrame,
    replies: DataFrame,
    path: str,
    progress_path: str,
    export_id: str,
    updated_at: str,
    channels: Sequence[str] | None = None,
    fmt: str = "markdown",
    split_by: str | None = None,
    oldest: str | None = None,
    newest: str | None = None,
    exclude_bots: bool = False,
    expand_threads: bool = True,
    workspace: str = "",
    mode: str = "anti_join",
    exported: DataFrame | None = None,
    compression: str = "none",
) -> Export:
    """Export what run ``export_id`` has not exported yet, then append its progress.

    The progress lies below ``progress_path`` as the tables ``progress``, ``expanded`` and ``exported``, which are only
    appended to. Channels the run has completed are left out, threads it has expanded too, and
    ``mode`` says how the rest of a channel is told apart (see :func:`channel_export`): by the ids the run
    has exported, or those of the table ``exported`` where one is given, or by the high-water mark, which loses
    older history. A run without channels and without saved progress is refused. ``compression`` is that of the JSON lines.
    """
    spark = messages.sparkSession
    saved, expanded, done = _saved(spark, progress_path, export_id)
    known = not saved.isEmpty()
    require_scope(channels, None, export_id if known else None)
    if known and not channels:
        channels = progress_ops.newest(saved).filter("channel IS NOT NULL").select("channel")
    export = channel_export(
        messages, replies, channels, oldest, newest, exclude_bots, expand_threads,
        progress=saved if known else None, exported=exported if exported is not None else done if known else None,
        mode=mode if known else "anti_join", store=True,
    ).without_expanded(expanded).dated(workspace, updated_at)
    if fmt == "json_lines":
        rows.write_json_lines(export, path, compression=compression)
    else:
        WRITERS[fmt](export, path, split_by=split_by)
    _append(export, saved, progress_path, export_id, updated_at, fmt)
    return export


def _saved(spark: SparkSession, path: str, export_id: str) -> list[DataFrame]:
    tables = []
    for name, ddl in (("progress", PROGRESS), ("expanded", EXPANDED), ("exported", EXPORTED)):
        spark.createDataFrame([], ddl).write.mode("append").parquet(f"{path}/{name}")  # makes the folder
        tables.append(spark.read.schema(ddl).parquet(f"{path}/{name}").filter(F.col("export_id") == export_id))
    return tables


def _append(export: Export, saved: DataFrame, path: str, export_id: str, updated_at: str, fmt: str) -> None:
    before = progress_ops.newest(saved).select(
        "channel", F.col("last_message_ts").alias("_mark"), F.col("message_count").alias("_count"), F.col("created_at").alias("_created")
    )
    now = export.channels.select("channel").distinct().join(progress_ops.high_water(export.counted), "channel", "left")
    merged = now.join(before, "channel", "left").select(
        F.lit(export_id).alias("export_id"),
        F.lit(export.workspace).alias("workspace_url"),
        "channel",
        F.lit(progress_ops.COMPLETED).alias("status"),
        F.coalesce(F.greatest("last_message_ts", "_mark"), F.lit("")).alias("last_message_ts"),
        (F.coalesce("message_count", F.lit(0)) + F.coalesce("_count", F.lit(0))).cast("bigint").alias("message_count"),
        F.lit(None).cast("string").alias("search_query"),
        F.coalesce("_created", F.lit(updated_at)).alias("created_at"),
        F.lit(updated_at).alias("updated_at"),
        F.lit(fmt).alias("format"),
    )
    taken = export.messages.select(F.lit(export_id).alias("export_id"), "channel", "timestamp")
    taken.write.mode("append").parquet(f"{path}/exported")  # before the marks: what is marked is never taken again
    merged.write.mode("append").parquet(f"{path}/progress")
    parents = threads.parent_ids(export.parents).select(F.lit(export_id).alias("export_id"), "channel", "parent_ts")
    parents.write.mode("append").parquet(f"{path}/expanded")
