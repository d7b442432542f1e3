"""Totals by channel and month, and run metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import times


def with_month(messages: DataFrame, captured_at: str | None = None) -> DataFrame:
    moment = times.message_datetime(
        F.col("timestamp"), F.col("datetime"), F.col(captured_at) if captured_at else None
    )
    return messages.withColumn("month", times.month_key(moment))


def month_totals(messages: DataFrame, expand_threads: bool = True, *more: Column) -> DataFrame:
    """Per month and channel: threads (by parent date), standalone messages, their sum, and ``more`` aggregates."""
    is_parent = (F.coalesce("reply_count", F.lit(0)) > 0) if expand_threads else F.lit(False)
    return messages.groupBy("month", "channel").agg(
        F.count_if(is_parent).alias("n_threads"),
        F.count_if(~is_parent).alias("n_standalone"),
        F.count(F.lit(1)).alias("total_messages"),
        *more,
    )


def channel_totals(messages: DataFrame, expand_threads: bool = True) -> DataFrame:
    """Per channel; replies are not counted."""
    return month_totals(messages.withColumn("month", F.lit("")), expand_threads).drop("month")


def attach_channels(totals: DataFrame, channels: DataFrame, keep_empty: bool) -> DataFrame:
    """Attach each channel's run metadata (first entry wins for repeated names).

    ``keep_empty`` keeps channels without content, as an unsplit export does; a month
    split drops them. Both inputs have one row per channel (and month).
    """
    first = channels.groupBy("channel").agg(
        F.min_by(F.struct("status", "export_started", "export_finished"), "channel_pos").alias("meta"),
        F.min("channel_pos").alias("channel_pos"),
    ).select("channel", "channel_pos", "meta.*")
    joined = totals.join(first, "channel", "full" if keep_empty else "left")
    counts = [c for c in ("n_threads", "n_standalone", "total_messages") if c in totals.columns]
    return joined.fillna(0, subset=counts)


def run_metadata(parents: DataFrame, replies: DataFrame, standalone: DataFrame) -> DataFrame:
    """One row of export totals; channel totals are combined first, so the last step sees few rows."""
    kinds = (
        parents.select("channel", F.lit("thread").alias("kind"))
        .unionByName(replies.select("channel", F.lit("reply").alias("kind")))
        .unionByName(standalone.select("channel", F.lit("standalone").alias("kind")))
    )
    per_channel = kinds.groupBy("channel").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("thread", "reply", "standalone")]
    )
    return per_channel.agg(
        F.count(F.lit(1)).alias("channel_count"),
        F.sum("thread").alias("total_threads"),
        F.sum("reply").alias("total_replies"),
        F.sum("standalone").alias("total_standalone"),
    )
