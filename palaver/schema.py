"""Canonical tables and the serialised shape of a message.

Identity of a message is ``(channel, timestamp)``; ``timestamp`` is a string id,
``datetime`` the human-readable label. ``seq`` orders the times a message was
seen and is unique per channel. ``pos`` numbers the replies of one thread and is
unique per ``(channel, parent_ts)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REACTION = "struct<emoji:string,count:int>"

# Serialised field order of a message; readers of the exports rely on it.
MESSAGE_FIELDS = ("user", "text", "timestamp", "datetime", "reactions", "is_bot", "attachments")

MESSAGE_COLUMNS = (
    f"user string, text string, timestamp string, datetime string, reactions array<{REACTION}>, "
    "is_bot boolean, attachments array<string>"
)
SNAPSHOTS = "channel string, snapshot_seq bigint, captured_at timestamp, html string"
MESSAGES = f"channel string, seq bigint, {MESSAGE_COLUMNS}, reply_count int"
REPLIES = f"channel string, parent_ts string, pos int, {MESSAGE_COLUMNS}"
CHANNELS = "channel string, channel_pos int, status string, export_started string, export_finished string"
PROGRESS = (
    "export_id string, workspace_url string, channel string, status string, last_message_ts string, "
    "message_count bigint, search_query string, created_at string, updated_at string, format string"
)
EXPANDED = "export_id string, channel string, parent_ts string"
EXPORTED = "export_id string, channel string, timestamp string"

FORMAT_VERSION = "1.0"
UNKNOWN_MONTH = "unknown"


def no_reactions() -> Column:
    return F.array().cast(f"array<{REACTION}>")


def no_attachments() -> Column:
    return F.array().cast("array<string>")


def as_messages(df: DataFrame, **columns: Column) -> DataFrame:
    """Project ``df`` to ``MESSAGES``; columns not given take the record's defaults."""
    return _project(df, MESSAGES, {"reply_count": F.lit(0), **columns})


def as_replies(df: DataFrame, **columns: Column) -> DataFrame:
    return _project(df, REPLIES, columns)


def _project(df: DataFrame, ddl: str, columns: dict[str, Column]) -> DataFrame:
    given = {
        "datetime": F.lit(""),
        "reactions": no_reactions(),
        "is_bot": F.lit(False),
        "attachments": no_attachments(),
        **columns,
    }
    fields = df.sparkSession.createDataFrame([], ddl).schema.fields
    return df.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in fields])
