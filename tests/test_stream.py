import os
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from palaver.functions import times
from palaver.operators import progress
from palaver.schema import MESSAGES
from palaver.streaming import event_time
from palaver.streaming import ingest as stream
from palaver.streaming import run as stream_run


def micros(day, hour=0):
    return str(int(datetime(2024, 1, day, hour, tzinfo=timezone.utc).timestamp()) * 1_000_000)


@pytest.fixture
def feed(spark, message_table, tmp_path):
    """Drop batches of messages into a folder that is read as a stream, one file per micro-batch."""
    class Feed:
        base = str(tmp_path)

        def __init__(self):
            self.spark = spark

        def add(self, *rows):
            time.sleep(0.05)  # files are taken by age
            message_table(*rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

        def read(self):
            return spark.readStream.schema(message_table().schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

        def stored(self, name="messages"):
            return spark.read.parquet(f"{tmp_path}/{name}")

    return Feed()


def texts(df):
    return sorted(r["text"] for r in df.collect())


def test_overlap_restart_and_late_rows(feed):
    def run():
        stream.ingest(feed.read(), f"{feed.base}/messages", f"{feed.base}/state").awaitTermination()
        return texts(feed.stored())

    feed.add({"timestamp": micros(10), "text": "a"}, {"timestamp": micros(11), "text": "b"}, {"timestamp": "", "text": "no id"})
    assert run() == ["a", "b"]
    assert run() == ["a", "b"]
    feed.add({"timestamp": micros(11), "text": "b again"}, {"timestamp": micros(20), "text": "c"}, {"timestamp": "undated", "text": "u"})
    assert run() == ["a", "b", "c", "u"]
    feed.add({"timestamp": micros(2), "text": "late"}, {"timestamp": micros(1), "text": "other channel", "channel": "b"})
    assert run() == ["a", "b", "c", "late", "other channel", "u"]


def test_lossless_keeps_late_rows_and_survives_replay(feed):
    def run(state):
        stream.ingest(feed.read(), f"{feed.base}/messages", f"{feed.base}/{state}").awaitTermination()
        return texts(feed.stored())

    feed.add({"timestamp": micros(20), "text": "c"}, {"timestamp": "undated", "text": "u"})
    assert run("state") == ["c", "u"]
    feed.add({"timestamp": micros(20), "text": "c again"}, {"timestamp": micros(1), "text": "late"}, {"timestamp": "undated", "text": "u again"})
    assert run("state") == ["c", "late", "u"]
    assert run("replayed from the start") == ["c", "late", "u"]


def test_replies_are_added_once(spark, reply_table, tmp_path):
    def run(state):
        source = spark.readStream.schema(reply_table().schema).parquet(f"{tmp_path}/in")
        stream.ingest_replies(source, f"{tmp_path}/replies", f"{tmp_path}/{state}").awaitTermination()
        return sorted(r["pos"] for r in spark.read.parquet(f"{tmp_path}/replies").collect())

    def add(*positions):
        reply_table(*[{"parent_ts": micros(3), "pos": p, "timestamp": micros(4, p)} for p in positions]).write.mode("append").parquet(f"{tmp_path}/in")

    add(1, 2, 2)
    assert run("s") == [1, 2]
    add(2, 3)
    assert run("s") == [1, 2, 3]
    assert run("again") == [1, 2, 3]


def test_replies_that_move_up_are_kept(spark, reply_table, tmp_path):
    for names in (["r1", "r2", "r3"], ["r1", "r3", "r4"]):
        rows = [{"parent_ts": micros(3), "pos": i + 1, "text": n, "timestamp": "" if n == "r1" else n} for i, n in enumerate(names)]
        reply_table(*rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(reply_table().schema).parquet(f"{tmp_path}/in")
        stream.ingest_replies(source, f"{tmp_path}/replies", f"{tmp_path}/state").awaitTermination()
    assert texts(spark.read.parquet(f"{tmp_path}/replies")) == ["r1", "r2", "r3", "r4"]


def test_counters_go_on_after_restart(spark, feed):
    def run():
        source = spark.readStream.schema(feed.stored("in").schema).parquet(f"{feed.base}/in")
        stream.counters(source, f"{feed.base}/counters", f"{feed.base}/state").awaitTermination()
        saved = stream.latest_counters(feed.stored("counters"))
        return {r["channel"]: (r["last_message_ts"], r["message_count"]) for r in saved.collect()}

    feed.add({"timestamp": "5"}, {"timestamp": "7"}, {"timestamp": "1", "channel": "quiet"})
    assert run() == {"general": ("7", 2), "quiet": ("1", 1)}
    feed.add({"timestamp": "6"})
    assert run() == {"general": ("7", 3), "quiet": ("1", 1)}


def run_of(feed, step, *names):
    step().awaitTermination()
    return [texts(event_time.read_batches(feed.spark, f"{feed.base}/{name}", MESSAGES)) for name in names]


def test_late_rows_go_to_a_table_of_their_own(feed):
    def run():
        return run_of(feed, lambda: event_time.ingest_within(feed.read(), f"{feed.base}/m", f"{feed.base}/state", "3 days"), "m/kept", "m/late")

    feed.add({"timestamp": micros(10), "text": "a"}, {"timestamp": micros(10), "text": "a again", "seq": 9}, {"timestamp": "odd", "text": "undated"})
    assert run() == [["a", "undated"], []]
    feed.add({"timestamp": micros(7), "text": "on the edge"}, {"timestamp": micros(7, 1), "text": "in time"}, {"timestamp": micros(10), "text": "a third time"})
    assert run() == [["a", "in time", "undated"], ["on the edge"]]
    feed.add({"timestamp": micros(30), "text": "b"}, {"timestamp": "odd", "text": "undated again"})
    assert run() == [["a", "b", "in time", "undated"], ["on the edge"]]
    # the first run's key has left the state, its copy is late and known; another is late and new
    feed.add({"timestamp": micros(10), "text": "a once more"}, {"timestamp": micros(11), "text": "late"}, {"timestamp": micros(7), "text": "edge again"})
    assert run() == [["a", "b", "in time", "undated"], ["late", "on the edge"]]
    assert run() == [["a", "b", "in time", "undated"], ["late", "on the edge"]]


def test_late_rows_survive_a_replay(feed):
    for day in (10, 20):
        feed.add({"timestamp": micros(day), "text": f"d{day}"}, {"timestamp": micros(day - 9), "text": f"d{day - 9}"})
        time.sleep(0.05)  # files are taken by age
    for state in ("state", "again"):
        found = run_of(feed, lambda: event_time.ingest_within(feed.read(), f"{feed.base}/m", f"{feed.base}/{state}", "2 days"), "m/kept", "m/late")
        assert found == [["d1", "d10", "d11", "d20"], []]
    feed.add({"timestamp": micros(2), "text": "d2"})
    for state in ("state", "again"):
        found = run_of(feed, lambda: event_time.ingest_within(feed.read(), f"{feed.base}/m", f"{feed.base}/{state}", "2 days"), "m/kept", "m/late")
        assert found == [["d1", "d10", "d11", "d20"], ["d2"]]


def replies_feed(spark, base, message_table, reply_table, parent_batches, reply_batches):
    for name, table, batches in (("parents", message_table, parent_batches), ("replies", reply_table, reply_batches)):
        for batch in batches:
            table(*batch).coalesce(1).write.mode("append").parquet(f"{base}/{name}")
            time.sleep(0.05)  # files are taken by age
    read = lambda name, table: spark.readStream.schema(table().schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/{name}")
    return read("parents", message_table), read("replies", reply_table)


@pytest.mark.parametrize("turned", [False, True])
def test_replies_meet_their_parents_in_any_order(spark, message_table, reply_table, tmp_path, turned):
    parents = [[{"timestamp": micros(day), "reply_count": 1}] for day in (3, 5, 4)]
    replies = [[{"parent_ts": micros(day), "pos": p, "text": f"{day}.{p}"} for p in (1, 2)] for day in (4, 6, 3)]
    if turned:
        parents, replies = parents[::-1], replies[::-1]
    replies.append([{"parent_ts": "undated", "text": "no time"}, {"parent_ts": micros(31), "channel": "", "text": "beat"}])
    parents.append([{"timestamp": micros(31), "channel": "", "reply_count": 1}])
    streams = replies_feed(spark, tmp_path, message_table, reply_table, parents, replies)
    for _ in range(2):
        event_time.join_replies(*streams, f"{tmp_path}/out", f"{tmp_path}/state", "10 days").awaitTermination()
        read = lambda name: texts(event_time.read_batches(spark, f"{tmp_path}/out/{name}", reply_table().schema).filter("channel <> ''"))
        assert read("replies") == ["3.1", "3.2", "4.1", "4.2"]
        assert read("orphans") == ["6.1", "6.2", "no time"]


def test_threads_wait_in_tables_that_follow_the_watermark(spark, message_table, reply_table, tmp_path):
    """No row of a thread is held by a state store; months the watermark has passed are deleted, late parents find nothing."""
    path, state = f"{tmp_path}/out", f"{tmp_path}/state"
    first = [{"timestamp": "1704067200000000"}], [{"parent_ts": micros(3), "text": "early"}, {"parent_ts": "undated", "text": "no time"}]
    then = [{"timestamp": "1717200000000000"}], [{"parent_ts": "1717200000000000", "text": "june"}, {"parent_ts": "1717200000000001", "text": "open"}]
    late = [{"timestamp": micros(3)}], [{"parent_ts": micros(3), "text": "too late"}]
    for number, (parents, replies) in enumerate((first, then, late)):
        streams = replies_feed(spark, tmp_path, message_table, reply_table, [parents], [replies])
        event_time.join_replies(*streams, path, state, "10 days").awaitTermination()
        found = [texts(event_time.read_batches(spark, f"{path}/{name}", reply_table().schema)) for name in ("replies", "orphans")]
        assert found == ([[], ["no time"]] if number == 0 else [["june"], ["early", "no time"]])
    assert not os.path.exists(f"{state}/state")
    months = {f for _, folders, _ in os.walk(f"{state}/threads/replies") for f in folders if f.startswith("_month=")}
    assert months == {"_month=2024-06"}


def test_counters_of_an_overlapping_stream(spark, feed):
    def run():
        event_time.day_counters(feed.read(), f"{feed.base}/days", f"{feed.base}/state", "1 day").awaitTermination()
        closed = event_time.read_batches(spark, f"{feed.base}/days", "channel string, day date, last_message_ts string, message_count bigint")
        still = event_time.open_days(spark, f"{feed.base}/state")
        return (closed.count(), {r["channel"]: (r["last_message_ts"], r["message_count"]) for r in event_time.counted(closed, still).collect()})

    feed.add({"timestamp": micros(3)}, {"timestamp": micros(3, 5)}, {"timestamp": micros(3), "seq": 7}, {"timestamp": micros(3), "channel": "quiet"}, {"timestamp": "odd"})
    assert run() == (0, {"general": (micros(3, 5), 2), "quiet": (micros(3), 1)})
    feed.add({"timestamp": micros(3, 5), "text": "again"}, {"timestamp": micros(4)})
    assert run() == (0, {"general": (micros(4), 3), "quiet": (micros(3), 1)})
    feed.add({"timestamp": micros(9)}, {"timestamp": micros(4), "text": "again"})
    closed, counts = run()
    assert closed == 3 and counts == {"general": (micros(9), 4), "quiet": (micros(3), 1)}


def test_run_broken_off_between_batches(spark, feed, monkeypatch):
    path, ddl = f"{feed.base}/run", MESSAGES
    start = lambda: stream_run.start_run(feed.read(), path, f"{feed.base}/state", "r", "t1")

    def saved():
        rows = stream_run.saved_progress(spark, path, "r").filter("channel IS NOT NULL")
        return {r.channel: (r.status, r.last_message_ts, r.message_count) for r in progress.latest(rows).collect()}

    for day in (3, 4, 5):
        feed.add({"timestamp": micros(day), "text": f"d{day}"}, {"timestamp": micros(day - 1), "text": f"copy {day - 1}", "seq": 9}, {"timestamp": micros(day), "channel": "b", "text": f"b{day}"})
        time.sleep(0.05)
    commit, calls = stream_run._commit, []

    def breaks(rows, *where):
        calls.append(where)
        if len(calls) == 2:
            raise OSError("the machine is gone")
        commit(rows, *where)

    monkeypatch.setattr(stream_run, "_commit", breaks)
    with pytest.raises(Exception, match="the machine is gone"):
        start().awaitTermination()
    # data of the second batch is written, but nothing of it counts yet
    assert os.path.isdir(f"{path}/messages/run=r/batch=1")
    assert texts(stream_run.committed(spark, path, "r", ddl)) == ["b3", "copy 2", "d3"]
    assert saved() == {"general": ("in_progress", micros(3), 2), "b": ("in_progress", micros(3), 1)}
    start().awaitTermination()
    assert texts(stream_run.committed(spark, path, "r", ddl)) == ["b3", "b4", "b5", "copy 2", "d3", "d4", "d5"]
    assert saved() == {"general": ("in_progress", micros(5), 4), "b": ("in_progress", micros(5), 3)}
    stream_run.finish_run(spark, path, "r", "t2")
    assert saved() == {"general": ("completed", micros(5), 4), "b": ("completed", micros(5), 3)}
    start().awaitTermination()
    assert texts(stream_run.committed(spark, path, "r", ddl)) == ["b3", "b4", "b5", "copy 2", "d3", "d4", "d5"]
    assert stream_run.committed(spark, path, "other", ddl).count() == 0
    stream_run.finish_run(spark, path, "other", "t2")
    assert stream_run.saved_progress(spark, path, "other").count() == 0


def test_events_that_share_an_id_are_told_apart_by_their_number(feed):
    feed.add({"timestamp": micros(3), "text": "a", "seq": 0}, {"timestamp": micros(3), "text": "b", "seq": 2}, {"timestamp": micros(3), "text": "A", "seq": 1})
    feed.add({"timestamp": micros(3), "text": "B", "seq": 3}, {"timestamp": micros(3), "text": "c", "seq": 4})
    for state in ("state", "again"):
        numbered = feed.read().selectExpr("*", "shiftright(seq, 1) AS event")
        stream.ingest(numbered, f"{feed.base}/messages", f"{feed.base}/{state}", key=[*stream.KEY, "event"]).awaitTermination()
        assert texts(feed.stored()) == ["a", "b", "c"]


def shared_ids(feed):
    """Five events of one channel and microsecond, the first two read twice; their number joins the key."""
    feed.add({"timestamp": micros(3), "text": "a", "seq": 0}, {"timestamp": micros(3), "text": "b", "seq": 2}, {"timestamp": micros(3), "text": "A", "seq": 1})
    feed.add({"timestamp": micros(3), "text": "B", "seq": 3}, {"timestamp": micros(3), "text": "c", "seq": 4})
    feed.add({"timestamp": micros(9), "text": "d", "seq": 6})
    feed.add({"timestamp": micros(3), "text": "e", "seq": 8}, {"timestamp": micros(3), "text": "C", "seq": 5})
    return feed.read().selectExpr("*", "shiftright(seq, 1) AS event"), [*stream.KEY, "event"]


def test_late_events_that_share_an_id(feed):
    numbered, key = shared_ids(feed)
    step = lambda: event_time.ingest_within(numbered, f"{feed.base}/m", f"{feed.base}/state", "2 days", key=key)
    assert run_of(feed, step, "m/kept", "m/late") == [["a", "b", "c", "d", "e"], []]
    feed.add({"timestamp": micros(3), "text": "f", "seq": 10}, {"timestamp": micros(3), "text": "E", "seq": 9})
    assert run_of(feed, step, "m/kept", "m/late") == [["a", "b", "c", "d", "e"], ["f"]]


def test_run_of_events_that_share_an_id(spark, feed):
    numbered, key = shared_ids(feed)
    stream_run.start_run(numbered, f"{feed.base}/run", f"{feed.base}/state", "r", "t1", key=key).awaitTermination()
    assert texts(stream_run.committed(spark, f"{feed.base}/run", "r", MESSAGES)) == ["a", "b", "c", "d", "e"]
    saved = progress.latest(stream_run.saved_progress(spark, f"{feed.base}/run", "r").filter("channel IS NOT NULL"))
    assert [(r.last_message_ts, r.message_count) for r in saved.collect()] == [(micros(9), 5)]


def test_day_counts_of_events_that_share_an_id(spark, feed):
    numbered, key = shared_ids(feed)
    event_time.day_counters(numbered, f"{feed.base}/days", f"{feed.base}/state", "7 days", key=key).awaitTermination()
    closed = event_time.read_batches(spark, f"{feed.base}/days", "channel string, day date, last_message_ts string, message_count bigint")
    found = event_time.counted(closed, event_time.open_days(spark, f"{feed.base}/state"))
    assert [(r.last_message_ts, r.message_count) for r in found.collect()] == [(micros(9), 5)]


@pytest.mark.parametrize("name, table", [("stream_replies", "conversations"), ("stream_dedup", "events")])
def test_a_table_in_several_files_is_read_as_a_stream(spark, tmp_path, name, table):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/{table}.parquet")
    rows.repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    found, expected = (entry.queries()[name](spark, where).collect() for where in (str(tmp_path), folder))
    assert found and sorted(map(str, found)) == sorted(map(str, expected))


def test_a_part_of_the_feed_is_one_micro_batch_of_many_files(spark, message_table, tmp_path):
    from palaver.queries import _batches

    many = spark.range(100).select("id")
    sizes = []
    feed = _batches(spark, many.repartition(5), many.limit(1), many.limit(0), many.filter("id > 40"))
    step = feed.writeStream.foreachBatch(lambda batch, _: sizes.append((batch.count(), batch.rdd.getNumPartitions() > 1)))
    step.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert [n for n, _ in sizes] == [100, 1, 0, 59] and sizes[0][1]


def test_small_months_are_one_file_each(spark, message_table, tmp_path, monkeypatch):
    rows = [{"timestamp": str(1_704_067_200_000_000 + day * 86_400_000_000), "text": str(day)} for day in range(180)]
    # dealt over eight tasks, every month would be a file in each; inside a stream tasks are not merged by size
    monkeypatch.setattr(stream, "FILE_ROWS", 1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    batch = message_table(*rows).repartition(8).withColumn("month", times.month_key(times.id_datetime(F.col("timestamp"))))
    stream.merge(batch, f"{tmp_path}/small", stream.KEY, "month")
    monkeypatch.setattr(stream, "FILE_ROWS", 5)
    stream.merge(batch, f"{tmp_path}/cut", stream.KEY, "month")
    for name, least, most in (("small", 6, 6), ("cut", 12, 48)):
        stored = spark.read.parquet(f"{tmp_path}/{name}")
        assert texts(stored) == sorted(str(day) for day in range(180))
        assert least <= stored.select(F.input_file_name()).distinct().count() <= most
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
