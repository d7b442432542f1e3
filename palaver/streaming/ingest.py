"""Incremental ingest of overlapping reads with Structured Streaming.

The stream checkpoint is the progress: a restart with the same checkpoint goes on
where the last run stopped. Each micro-batch is compared with the stored table, so a
row is never dropped for being late: history of one channel read after another's, and
rows without a date, are kept like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palaver.functions import times
from palaver.operators import clean, threads

KEY = ["channel", "timestamp"]
FILE_ROWS = 250_000  # rows of a file, about


def ingest(stream: DataFrame, path: str, checkpoint: str, order: str = "seq", key: Sequence[str] = KEY) -> StreamingQuery:
    """Append messages not yet stored; a replayed micro-batch adds nothing twice.

    ``key`` tells messages apart. Where a source gives several messages of a channel one id, a column
    with the source's own number joins it; the id stays in the key, since the month goes by it.

    The month is that of the id, so copies of a message share it whatever their
    labels say; messages dated by label alone are filed under ``unknown``.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        distinct = clean.first_seen(clean.with_ids(batch), key, (order,))
        month = times.month_key(times.id_datetime(F.col("timestamp")))
        merge(distinct.withColumn("month", month), path, key, "month")

    return _for_each_batch(stream, save, checkpoint)


def ingest_replies(stream: DataFrame, path: str, checkpoint: str, order: tuple[str, ...] = ("pos",)) -> StreamingQuery:
    """Append thread replies not yet stored; threads are nested when read.

    A reply is known by its id, without one by label and text: its place in the panel
    changes when others are deleted. Of copies in a micro-batch the first in ``order`` is kept.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("reply_key", threads.reply_key())
        key = ["channel", "parent_ts", "reply_key"]
        parent_month = times.month_key(times.id_datetime(F.col("parent_ts")))
        merge(clean.first_seen(keyed, key, order).withColumn("month", parent_month), path, key, "month")

    return _for_each_batch(stream, save, checkpoint)


def merge(batch: DataFrame, path: str, key: Sequence[str], partition: str) -> None:
    """Append the rows whose key the table lacks. Only partitions present in the batch are read.

    The partition is a function of the key, so equal keys meet in the same one.
    """
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        batch.limit(0).write.mode("append").partitionBy(partition).parquet(path)  # makes the folder
        touched = batch.select(partition).distinct()  # prunes the partitions read, at run time
        stored = spark.read.schema(batch.schema).parquet(path).join(touched, partition, "left_semi")
        new = batch.join(stored.select(*key), list(key), "left_anti").select(*batch.columns)
        # one file for a small partition, however many tasks there are; a large one is cut by key
        sizes = batch.groupBy(partition).agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("_files"))
        slot = F.pmod(F.xxhash64(*key), F.coalesce("_files", F.lit(1)))
        dealt = new.join(sizes, partition, "left").repartition(partition, slot).drop("_files")
        dealt.write.mode("append").partitionBy(partition).parquet(path)
    finally:
        batch.unpersist()


def counters(distinct: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running count and high-water mark per channel, appended after every micro-batch.

    ``distinct`` is the stream of a table without repeated messages. Counts are
    combined before the exchange, so a hot channel is one state row per task.
    """
    running = distinct.groupBy("channel").agg(
        F.max("timestamp").alias("last_message_ts"), F.count(F.lit(1)).alias("message_count")
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(path)

    return (
        running.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_counters(saved: DataFrame) -> DataFrame:
    """Newest counters per channel; a replayed batch saved the same values again."""
    return clean.first_seen(saved, ("channel",), (F.desc("batch_id"),)).drop("batch_id")


def _for_each_batch(stream: DataFrame, save, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
