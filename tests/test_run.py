import pytest
from pyspark.sql import functions as F

from palaver.operators import progress
from palaver.plans.run import run_export


def lines(spark, path):
    return sorted(r.value for r in spark.read.text(path).collect() if r.value)


def test_two_saves_of_two_runs(spark, message_table, reply_table, tmp_path):
    replies = reply_table({"parent_ts": "5", "pos": 1, "timestamp": "6", "text": "reply"})
    rows = message_table({"timestamp": "5", "text": "parent", "reply_count": 1}, {"timestamp": "7", "text": "seven"}, {"timestamp": "1", "text": "other", "channel": "b"})

    def run(export_id, at, table, channels=None, **options):
        return run_export(table, replies, f"{tmp_path}/{export_id}-{at}", f"{tmp_path}/progress", export_id, at, channels, **options)

    def saved():
        return {(r["export_id"], r["channel"]): (r["last_message_ts"], r["message_count"], r["status"]) for r in progress.latest(spark.read.parquet(f"{tmp_path}/progress/progress")).collect()}

    with pytest.raises(ValueError):
        run("r1", "a", rows)
    run("r1", "a", rows, ["general"])
    assert "seven" in lines(spark, f"{tmp_path}/r1-a") and "> reply" in lines(spark, f"{tmp_path}/r1-a")
    assert saved() == {("r1", "general"): ("7", 2, "completed")}
    run("r2", "a", rows, ["general", "b"], fmt="text")
    assert saved()["r2", "b"] == ("1", 1, "completed") and saved()["r1", "general"] == ("7", 2, "completed")

    # the run was broken off after its first channel: its newest save says so
    table = spark.read.parquet(f"{tmp_path}/progress/progress").filter("export_id = 'r1'")
    table.withColumn("status", F.lit("in_progress")).withColumn("updated_at", F.lit("b")).write.mode("append").parquet(f"{tmp_path}/progress/progress")
    more = rows.unionByName(message_table({"timestamp": "9", "text": "nine", "seq": 9}))
    rest = run("r1", "c", more)
    assert sorted(r["text"] for r in rest.messages.collect()) == ["nine"]
    assert saved()["r1", "general"] == ("9", 3, "completed")
    assert run("r1", "d", more).messages.count() == 0
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/progress/expanded").collect())) == [("r1", "general", "5"), ("r2", "general", "5")]
    assert {r["export_id"]: r["channels"] for r in progress.status(spark.read.parquet(f"{tmp_path}/progress/progress")).collect()} == {"r1": "1/1 completed", "r2": "2/2 completed"}
