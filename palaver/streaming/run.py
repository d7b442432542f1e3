"""An export as a stream that saves its progress with every micro-batch.

A micro-batch is committed in two parts under its number: its new messages, then a progress row per
channel. Readers see the messages of committed batches only, so data and progress change together; a
batch that was broken off between the two is written anew when the run is restarted with its checkpoint.
How much a batch reads is the source's choice (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from palaver.operators import clean
from palaver.operators import progress as progress_ops
from palaver.schema import PROGRESS
from palaver.streaming.ingest import KEY, _for_each_batch

IN_PROGRESS = "in_progress"
_BATCH = "batch bigint"


def start_run(
    stream: DataFrame, path: str, checkpoint: str, export_id: str, updated_at: str, workspace: str = "", fmt: str = "json", order: str = "seq",
    key: Sequence[str] = KEY,
) -> StreamingQuery:
    """Messages below ``path/messages``, progress below ``path/progress``, each by run and micro-batch.

    Channels stay ``in_progress`` until :func:`finish_run`. A message already committed is not taken again;
    ``key`` tells messages apart, as in :func:`palaver.streaming.ingest.ingest`.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        distinct = clean.first_seen(clean.with_ids(batch), key, (order,))
        before = committed(spark, path, export_id, batch.schema, batch_id)
        new = distinct.join(before.select(*key), list(key), "left_anti").select(*batch.columns)
        folder = f"{path}/messages/run={export_id}/batch={batch_id}"
        new.write.mode("overwrite").parquet(folder)
        saved = progress_ops.high_water(spark.read.schema(batch.schema).parquet(folder))
        _commit(_advanced(spark, path, export_id, saved, batch_id, IN_PROGRESS, updated_at, workspace, fmt), path, export_id, batch_id)

    return _for_each_batch(stream, save, checkpoint)


def finish_run(spark: SparkSession, path: str, export_id: str, updated_at: str) -> None:
    """Mark every channel the run has seen as completed; the commit holds no messages and comes after all batches."""
    last = saved_progress(spark, path, export_id)
    numbers = last.agg(F.max("batch")).first()[0]
    if numbers is None:
        return
    done = _newest(last).withColumn("status", F.lit(progress_ops.COMPLETED)).withColumn("updated_at", F.lit(updated_at))
    _commit(done.select(*_columns(spark)), path, export_id, f"{numbers}.done")


def saved_progress(spark: SparkSession, path: str, export_id: str | None = None) -> DataFrame:
    """All saves as ``PROGRESS`` rows with the number of their micro-batch."""
    rows = _read(spark, f"{path}/progress", f"{PROGRESS}, {_BATCH}")
    return rows if export_id is None else rows.filter(F.col("export_id") == export_id)


def committed(spark: SparkSession, path: str, export_id: str, schema: StructType | str, before: int | None = None) -> DataFrame:
    """Messages of the run's committed micro-batches (those with a smaller number than ``before``)."""
    done = saved_progress(spark, path, export_id).select("batch").distinct()
    # the marker of an empty batch has no channel; the numbers are one row a batch
    numbers = sorted(r.batch for r in done.collect() if before is None or r.batch < before)
    files = [f"{path}/messages/run={export_id}/batch={n}" for n in numbers]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _columns(spark: SparkSession) -> list[str]:
    return [*spark.createDataFrame([], PROGRESS).columns, "batch"]


def _newest(saves: DataFrame) -> DataFrame:
    return clean.first_seen(saves.filter("channel IS NOT NULL"), ("export_id", "channel"), (F.desc("batch"), F.desc("updated_at"), "status"))


def _advanced(spark, path, export_id, found, batch_id, status, updated_at, workspace, fmt) -> DataFrame:
    """Progress after a micro-batch: its own figures added to the newest of the batches before it; one row without channel marks the commit."""
    before = _newest(saved_progress(spark, path, export_id).filter(F.col("batch") < batch_id))
    before = before.select("channel", F.col("last_message_ts").alias("_mark"), F.col("message_count").alias("_count"), F.col("created_at").alias("_created"))
    rows = found.join(before, "channel", "left").select(
        "channel",
        F.greatest("last_message_ts", "_mark").alias("last_message_ts"),
        (F.col("message_count") + F.coalesce("_count", F.lit(0))).alias("message_count"),
        F.coalesce("_created", F.lit(updated_at)).alias("created_at"),
    )
    mark = spark.createDataFrame([(None, "", 0, updated_at)], "channel string, last_message_ts string, message_count bigint, created_at string")
    fixed = {"export_id": export_id, "workspace_url": workspace, "status": status, "search_query": None, "updated_at": updated_at, "format": fmt}
    full = rows.unionByName(mark)
    for name, value in fixed.items():
        full = full.withColumn(name, F.lit(value).cast("string"))
    return full.withColumn("batch", F.lit(batch_id).cast("bigint")).select(*_columns(spark))


def _commit(rows: DataFrame, path: str, export_id: str, name: int | str) -> None:
    # written whole beside the others: a folder counts once its rows are there
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/progress/{export_id}/{name}")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
