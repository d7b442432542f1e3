"""Streams with event-time state: bounded memory, late rows set apart, replies before their parents.

What a stateful operator holds is evicted once the watermark has passed it, so state follows the
delay and not the history. Rows that come after that are not lost: they are filed in a table of their own.
Every table is written by micro-batch, a replayed batch replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from palaver.functions import times
from palaver.operators import clean
from palaver.schema import UNKNOWN_MONTH
from palaver.streaming.ingest import FILE_ROWS, KEY, _for_each_batch, merge
from palaver.streaming.run import _read


def ingest_within(stream: DataFrame, path: str, checkpoint: str, delay: str, order: str = "seq", key: Sequence[str] = KEY) -> StreamingQuery:
    """Distinct messages below ``path/kept``, those behind the watermark below ``path/late``.

    A message is late if its time lies ``delay`` or more before the newest one of the micro-batches up to the last
    but one and no copy of it has been kept. Of copies in a micro-batch the first in ``order`` is kept. Keys are
    remembered for the delay only; rows without a date cannot be late and are compared with the table. Kept and late rows
    together have every message that came in. ``key`` as in :func:`palaver.streaming.ingest.ingest`.
    """
    key = list(key)
    # one source feeds both branches: what came in, and what the state lets pass
    named = clean.with_ids(stream).withColumn("moment", times.id_datetime(F.col("timestamp")))
    new = named.filter("moment IS NOT NULL").withWatermark("moment", delay).dropDuplicatesWithinWatermark(key)
    both = named.withColumn("passed", F.lit(False)).unionByName(new.withColumn("passed", F.lit(True)))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            # a micro-batch can repeat a key with another first copy in the state than by the order
            seen = clean.first_seen(batch.filter("NOT passed"), key, (order,)).withColumn("month", times.month_key(F.col("moment")))
            passed = batch.filter("passed OR moment IS NULL").select(*key).distinct()
            kept = seen.join(passed, key, "left_semi").drop("passed", "moment")
            merge(kept, f"{path}/kept", key, "month")
            rest = seen.filter("moment IS NOT NULL").drop("passed", "moment")
            stored = batch.sparkSession.read.schema(rest.schema).parquet(f"{path}/kept")
            touched = rest.select("month").distinct()
            late = rest.join(stored.join(touched, "month", "left_semi").select(*key), key, "left_anti")
            merge(late, f"{path}/late", key, "month")
        finally:
            batch.unpersist()

    return _for_each_batch(both, save, checkpoint)


def join_replies(parents: DataFrame, replies: DataFrame, path: str, checkpoint: str, delay: str) -> StreamingQuery:
    """Replies with a parent below ``path/replies``, those without one below ``path/orphans``, in whichever order they come.

    Both streams are tables in the shape of :mod:`palaver.schema`, without repeated rows. Both sides wait in state, a reply
    for its parent until the watermark has passed the parent's time: then it is an orphan. ``delay`` is how
    long after a message its thread may still be incomplete; a parent that comes later leaves its replies
    orphans. Threads of undated parents have no time to wait for and are orphans at once unless read in batch.

    The state is tables below the checkpoint, see :class:`_Threads`: what comes is added to them, a micro-batch is joined with
    the months it touches, and months the watermark has passed are deleted. The watermark is that of Spark's own
    joins: ``delay`` before the newest time of the side that is behind, in force from the next micro-batch on, and when the
    stream has been read to its end.
    """
    threads = _Threads(parents.sparkSession, path, f"{checkpoint}/threads", replies.schema, delay)
    heads = parents.select("channel", F.col("timestamp").alias("parent_ts"), F.lit(True).alias("_head"))
    both = heads.unionByName(replies.withColumn("_head", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("_moment", times.id_datetime(F.col("parent_ts")))
    return _Closing(_for_each_batch(both, threads.save, checkpoint), threads.close)


class _Closing(StreamingQuery):
    """A query with a last step of its own, once it has come to its end."""

    def __init__(self, query: StreamingQuery, close: Callable[[], None]) -> None:
        super().__init__(query._jsq)
        self._close = close

    def awaitTermination(self, timeout: int | None = None) -> bool | None:
        ended = super().awaitTermination(timeout)
        if timeout is None or ended:
            self._close()
        return ended

    def processAllAvailable(self) -> None:
        super().processAllAvailable()
        self._close()


class _Threads:
    """The two sides of :func:`join_replies` as tables ``heads`` and ``replies`` by micro-batch and month of the parent.

    A micro-batch writes folders of its own and reads those before it, so a replayed one finds what it found the first time.
    ``steps`` has a row for each: the watermark that rows have been evicted by and the one to follow.
    """

    _STEP = "batch bigint, closing boolean, evicted bigint, watermark bigint"
    _KEY = ["channel", "parent_ts"]

    def __init__(self, spark: SparkSession, path: str, state: str, schema: StructType, delay: str) -> None:
        self.spark, self.path, self.state = spark, path, state
        self.columns = schema.names
        self.newest = {name: 0 for name, _ in _SIDES}
        wanted = {"heads": [f for f in schema.fields if f.name in self._KEY], "replies": schema.fields}
        added = spark.createDataFrame([], "_moment timestamp, _batch bigint, _month string").schema.fields
        self.schemas = {name: StructType([*fields, *added]) for name, fields in wanted.items()}
        intervals = spark._jvm.org.apache.spark.sql.catalyst.util.IntervalUtils
        self.delay = intervals.getDuration(intervals.fromIntervalString(delay), spark._jvm.java.util.concurrent.TimeUnit.MILLISECONDS, 31)
        if self.delay < 0:
            raise ValueError(f"negative delay {delay}")

    def save(self, batch: DataFrame, batch_id: int) -> None:
        # a batch that comes again takes back the end of the stream it was
        _delete(self.spark, f"{self.path}/orphans/batch={batch_id}.end", f"{self.state}/steps/{batch_id}.end")
        last = self._last(batch_id)
        late, passed = last.evicted, last.watermark
        months = self._add(batch, batch_id, late)
        new, old = ({name: df.filter(where) for name, df in self._held(late).items()} for where in (F.col("_batch") == batch_id, F.col("_batch") < batch_id))
        # of a thread that the watermark has passed only what waited is joined
        heads = new["heads"].filter(F.col("_moment") > _instant(passed)).unionByName(old["heads"].filter(F.col("_month").isin(months["replies"])))
        found = self._joined(new["replies"], heads, "inner")
        found = found.unionByName(self._joined(old["replies"].filter(F.col("_month").isin(months["heads"])), new["heads"], "inner"))
        found.write.mode("overwrite").parquet(f"{self.path}/replies/batch={batch_id}")
        orphans = self._stored("replies").filter((F.col("_batch") == batch_id) & F.col("_moment").isNull()).select(*self.columns)
        if passed > late:
            orphans = orphans.unionByName(self._joined(_until(new["replies"], passed), _until(old["heads"], passed), "left_anti"))
            both = _until(old["heads"], passed).unionByName(_until(new["heads"], passed))
            orphans = orphans.unionByName(self._joined(_until(old["replies"], passed), both, "left_anti"))
        orphans.write.mode("overwrite").parquet(f"{self.path}/orphans/batch={batch_id}")
        # a side that this run has not heard of yet holds the watermark back
        self._log(batch_id, False, passed, max(passed, min(self.newest.values()) - self.delay))
        self._forget(late)

    def close(self) -> None:
        """The stream has been read to its end: the watermark of its last micro-batch comes into force."""
        last = self._last()
        passed = last.watermark
        if passed > last.evicted:
            held = self._held(last.evicted)
            orphans = self._joined(_until(held["replies"], passed), _until(held["heads"], passed), "left_anti")
            orphans.write.mode("overwrite").parquet(f"{self.path}/orphans/batch={last.batch}.end")
            self._log(last.batch, True, passed, passed)

    def _add(self, batch: DataFrame, batch_id: int, late: int) -> dict[str, list[str]]:
        """Add the rows that are not late to the tables and note the newest time of either side; the months of the rows."""
        batch = batch.withColumn("_month", times.month_key(F.col("_moment"))).persist()
        try:
            sizes = batch.groupBy("_head", "_month").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("_files"), F.unix_millis(F.max("_moment")).alias("newest")).collect()
            months = {name: [r._month for r in sizes if r._head == head] for name, head in _SIDES}
            for name, head in _SIDES:
                self.newest[name] = max(self.newest[name], *(r.newest for r in sizes if r._head == head and r.newest is not None), 0)
                files = batch.sparkSession.createDataFrame([(r._month, r._files) for r in sizes if r._head == head], "_month string, _files bigint")
                waits = F.col("_moment") > _instant(late)
                rows = batch.filter(F.col("_head") == head).filter(waits if head else waits | F.col("_moment").isNull())
                # as in merge(): one file for a month of few rows, one of many is cut by thread
                slot = F.pmod(F.xxhash64(*self._KEY), F.coalesce("_files", F.lit(1)))
                dealt = rows.join(F.broadcast(files), "_month", "left").repartition("_month", slot)
                kept = [f.name for f in self.schemas[name].fields if f.name != "_batch"]
                dealt.select(*kept).write.mode("overwrite").partitionBy("_month").parquet(f"{self.state}/{name}/_batch={batch_id}")
        finally:
            batch.unpersist()
        return months

    def _joined(self, replies: DataFrame, heads: DataFrame, how: str) -> DataFrame:
        return replies.join(heads.select(*self._KEY), self._KEY, how).select(*self.columns)

    def _stored(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.state}/{name}")

    def _held(self, late: int) -> dict[str, DataFrame]:
        """Both tables without what has been evicted."""
        return {name: self._stored(name).filter((F.col("_moment") > _instant(late)) & (F.col("_month") >= _month(late))) for name, _ in _SIDES}

    def _last(self, before: int | None = None) -> Row:
        """The newest step (of the micro-batches with a smaller number than ``before``)."""
        # one row a micro-batch
        steps = _read(self.spark, f"{self.state}/steps", self._STEP)
        steps = steps if before is None else steps.filter(F.col("batch") < before)
        return steps.orderBy(F.desc("batch"), F.desc("closing")).first() or Row(batch=-1, closing=False, evicted=0, watermark=0)

    def _log(self, batch_id: int, closing: bool, *values: int) -> None:
        row = self.spark.createDataFrame([(batch_id, closing, *values)], self._STEP)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.state}/steps/{batch_id}{'.end' if closing else ''}")

    def _forget(self, late: int) -> None:
        """Delete the months in which all is late, and the undated rows: they do not wait."""
        folders, fs = _files(self.spark, f"{self.state}/*/_batch=*/_month=*")
        for found in fs.globStatus(folders):
            month = found.getPath().getName().removeprefix("_month=")
            if month == UNKNOWN_MONTH or month < _month(late):
                fs.delete(found.getPath(), True)


_SIDES = (("heads", True), ("replies", False))


def _instant(millis: int) -> Column:
    return F.timestamp_millis(F.lit(millis))


def _month(millis: int) -> str:
    return datetime.fromtimestamp(millis / 1000, UTC).strftime("%Y-%m")


def _until(rows: DataFrame, passed: int) -> DataFrame:
    return rows.filter((F.col("_moment") <= _instant(passed)) & (F.col("_month") <= _month(passed)))


def _files(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        folder, fs = _files(spark, path)
        fs.delete(folder, True)


def heartbeat(spark: SparkSession, schema: str, **columns) -> DataFrame:
    """A row that belongs to no thread, to move the watermark on where a quiet source would hold it back."""
    fields = spark.createDataFrame([], schema).schema.fields
    return spark.range(1).select(*[F.lit(columns.get(f.name)).cast(f.dataType).alias(f.name) for f in fields])


def day_counters(stream: DataFrame, path: str, checkpoint: str, delay: str, key: Sequence[str] = KEY) -> StreamingQuery:
    """Count and largest id per channel and day of an overlapping stream, appended below ``path`` when a day is over.

    Two stateful operators in a chain: copies go, then the rest is counted by day. Days still open are
    in the state alone: see :func:`open_days`. Undated and late messages are not counted.
    """
    key = list(key)
    named = clean.with_ids(stream).withColumn("moment", times.id_datetime(F.col("timestamp")))
    new = named.filter("moment IS NOT NULL").withWatermark("moment", delay).dropDuplicatesWithinWatermark(key)
    days = new.groupBy("channel", F.window("moment", "1 day")).agg(F.max("timestamp").alias("last_message_ts"), F.count(F.lit(1)).alias("message_count"))

    def save(batch: DataFrame, batch_id: int) -> None:
        closed = batch.select("channel", F.col("window.start").cast("date").alias("day"), "last_message_ts", "message_count")
        closed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return days.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_days(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The days :func:`day_counters` has not closed yet, read from its state: ``channel, day, last_message_ts, message_count``."""
    operators = spark.read.format("state-metadata").load(checkpoint)
    counting = operators.filter("operatorName = 'stateStoreSave'").select("operatorId").first()
    if counting is None:
        return spark.createDataFrame([], "channel string, day date, last_message_ts string, message_count bigint")
    state = spark.read.format("statestore").option("operatorId", counting[0]).load(checkpoint)
    values = state.schema["value"].dataType.fieldNames()
    keys = state.schema["key"].dataType.fieldNames()
    return state.select(
        F.col(f"key.`{keys[0]}`").alias("channel"),
        F.col(f"key.`{keys[1]}`").getField("start").cast("date").alias("day"),
        F.col(f"value.`{values[0]}`").alias("last_message_ts"),
        F.col(f"value.`{values[1]}`").alias("message_count"),
    )


def counted(closed: DataFrame, still_open: DataFrame) -> DataFrame:
    """Count and largest id per channel, of closed and open days together."""
    days = closed.select("channel", "last_message_ts", "message_count").unionByName(still_open.select("channel", "last_message_ts", "message_count"))
    return days.groupBy("channel").agg(F.max("last_message_ts").alias("last_message_ts"), F.sum("message_count").alias("message_count"))


def read_batches(spark: SparkSession, path: str, schema: str | Sequence) -> DataFrame:
    """All micro-batches of a table written by batch."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
