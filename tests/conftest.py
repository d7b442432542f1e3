"""Shared session and small hand-made tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from palaver import schema  # noqa: E402
from palaver.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def message_table(spark):
    """Build a messages table from dicts; fields left out take their defaults."""
    return lambda *rows: _table(spark, schema.MESSAGES, {"channel": "general", "reply_count": 0}, rows, numbered=True)


@pytest.fixture
def reply_table(spark):
    return lambda *rows: _table(spark, schema.REPLIES, {"channel": "general", "pos": 1, "parent_ts": ""}, rows)


def _table(spark, ddl, extra, rows, numbered=False):
    base = {"user": "mara", "text": "hi", "timestamp": "", "datetime": "", "reactions": [], "is_bot": False, "attachments": []}
    fields = spark.createDataFrame([], ddl).columns
    filled = []
    for number, row in enumerate(rows):
        values = {**base, **extra, **({"seq": number} if numbered else {}), **row}
        filled.append(tuple(values[f] for f in fields))
    return spark.createDataFrame(filled, ddl)


@pytest.fixture
def market(spark, message_table, reply_table):
    """Two standalone messages around two threads; one thread has three replies, the other lost its only one."""
    ladder, empty = "1709373600000001", "1712000000"
    rows = message_table(
        {"user": "nadia", "text": "Stall 14 opens late", "timestamp": "1709287200", "attachments": ["x" * 130, "map", ""]},
        {"user": "ruben", "text": "Who has the ladder?", "timestamp": ladder, "datetime": "2 Mar 2024, 11:00", "reactions": [("eyes", 1), ("heart", 12)], "reply_count": 3},
        {"user": "tally", "text": "3 < 5 & so on\n\nend", "timestamp": "1709294400000000", "is_bot": True},
        {"user": "olga", "text": "", "timestamp": empty, "reply_count": 1},
    ).withColumn("channel", F.lit("market"))
    replies = reply_table(
        {"parent_ts": ladder, "pos": 2, "user": "pim", "text": "Wait\n\nhere", "timestamp": "1709373900000000", "reactions": [("+1", 2)]},
        {"parent_ts": ladder, "pos": 1, "user": "olga", "text": "Not me", "timestamp": "1709380000", "datetime": "noon"},
        {"parent_ts": ladder, "pos": 3, "user": "tally", "text": 'back at "5" \\ é', "timestamp": "1709373700000000", "is_bot": True, "attachments": ["rung"]},
    ).withColumn("channel", F.lit("market"))
    return rows, replies
