"""Row-oriented exports: JSON lines or XML, one record per thread page or message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.times import year_of
from palaver.operators import summary, threads
from palaver.plans.export import Export


def thread_records(export: Export, page_size: int = threads.PAGE_SIZE) -> DataFrame:
    """``month, channel, page, record`` with the serialised thread as JSON text."""
    nested = export.nested_threads(page_size)
    months = export.with_month(nested.select("*", F.col("parent.timestamp"), F.col("parent.datetime")))
    record = F.struct("parent", "replies", "reply_count")
    return months.select("month", "channel", "timestamp", "page", _json(record).alias("record"))


def message_records(export: Export) -> DataFrame:
    """``month, channel, record`` with each standalone message as JSON text."""
    months = export.with_month(export.standalone)
    return months.select("month", "channel", "timestamp", _json(threads.message_struct()).alias("record"))


def channel_records(export: Export) -> DataFrame:
    """One record per channel: its metadata and totals, without content."""
    totals = summary.channel_totals(export.counted, export.expand_threads)
    joined = summary.attach_channels(totals, export.channels, keep_empty=True)
    record = F.struct("channel", "status", "export_started", "export_finished", "total_messages")
    return joined.select("channel", "channel_pos", _json(record).alias("record"))


def manifest(export: Export) -> DataFrame:
    spark = export.messages.sparkSession
    return spark.range(1).select(
        F.lit(export.workspace).alias("workspace"),
        F.lit(export.export_date).alias("export_date"),
        F.lit(export.format_version).alias("format_version"),
    )


def write_json_lines(export: Export, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """Below ``path``: ``threads`` and ``standalone`` by year and month, ``channels``, ``manifest``.

    Range partitioning by month, channel and id keeps files few and cuts large months. ``compression`` is that of
    Spark's text writer for threads and standalone messages, for instance ``gzip``.
    """
    for name, records in (("threads", thread_records(export)), ("standalone", message_records(export))):
        order = ["year", "month", "channel", "timestamp"] + (["page"] if name == "threads" else [])
        (
            records.withColumn("year", year_of(F.col("month")))
            .repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .select("year", "month", F.col("record").alias("value"))
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")  # months not in this export stay
            .option("compression", compression)
            .partitionBy("year", "month")
            .text(f"{path}/{name}")
        )
    channel_records(export).select(F.col("record").alias("value")).write.mode(mode).text(f"{path}/channels")
    manifest(export).write.mode(mode).json(f"{path}/manifest")


def write_xml(export: Export, path: str, mode: str = "overwrite", page_size: int = threads.PAGE_SIZE, compression: str = "none") -> None:
    """Threads and standalone messages as XML rows."""
    nested = export.nested_threads(page_size).drop("n_replies")
    single = export.standalone.select("channel", threads.message_struct().alias("message"))
    for name, rows, tag in (("threads", nested, "thread"), ("standalone", single, "entry")):
        xml = rows.write.mode(mode).format("xml").option("rowTag", tag).option("rootTag", name)
        xml.option("compression", compression).save(f"{path}/{name}")


def _json(record):
    return F.to_json(record, {"ignoreNullFields": "false"})
