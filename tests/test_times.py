from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palaver.functions import text, times
from palaver.queries import QUERIES


@pytest.mark.parametrize(
    "ids, label, expected",
    [
        ("1718452800000000", "", datetime(2024, 6, 15, 12)),
        ("1718452800", "", datetime(2024, 6, 15, 12)),
        ("1718452800", "Oct 3, 2023 7:41 PM", datetime(2024, 6, 15, 12)),
        ("xyz", "Oct 3, 2023 7:41 PM", datetime(2023, 10, 3, 19, 41)),
        ("xyz", "January 5th, 2025 at 12:05:09 PM", datetime(2025, 1, 5, 12, 5, 9)),
        ("xyz", "Monday, 5 Feb 2024", datetime(2024, 2, 5)),
        ("xyz", "12:10 AM, Dec 1, 2024", datetime(2024, 12, 1, 0, 10)),
        ("xyz", "2024-02-29 23:59", datetime(2024, 2, 29, 23, 59)),
        ("xyz", "2024-02-30", None),
        ("xyz", "3/7/2024 4:05pm", datetime(2024, 3, 7, 16, 5)),
        ("xyz", "Today at 14:02:38", datetime(2024, 7, 1, 14, 2, 38)),
        ("xyz", "Yesterday at 2:02 PM", datetime(2024, 6, 30, 14, 2)),
        ("xyz", "Mar 3rd at 9:05 AM", datetime(2024, 3, 3, 9, 5)),
        ("xyz", "", None),
        ("xyz", "no time here", None),
        ("xyz", "12 parrots", None),
        ("123456789", "", None),
        ("171845280000", "", None),
        ("171845280000000", "", None),
        ("+71845280000000", "", None),
        ("1718452800\n", "", None),
        ("٣١٧١٨٤٥٢٨٠", "", None),
    ],
)
def test_message_datetime(spark, ids, label, expected):
    row = spark.createDataFrame([(ids, label, datetime(2024, 7, 1, 8))], "id string, label string, captured timestamp")
    moment = times.message_datetime(F.col("id"), F.col("label"), F.col("captured"))
    assert row.select(F.date_format(moment, "yyyy-MM-dd HH:mm:ss")).first()[0] == (
        expected.strftime("%Y-%m-%d %H:%M:%S") if expected else None
    )


def test_labels_without_a_year_need_the_capture_time(spark):
    row = spark.createDataFrame([("Today at 14:02",), ("Mar 3 at 9:05 AM",)], "label string")
    assert [r[0] for r in row.select(times.label_datetime(F.col("label"))).collect()] == [None, None]


def test_month_and_year(spark):
    row = spark.range(1).select(
        times.month_key(F.lit("2024-03-09 10:00:00").cast("timestamp")).alias("m"),
        times.month_key(F.lit(None).cast("timestamp")).alias("u"),
    ).withColumn("y", times.year_of(F.col("m"))).withColumn("uy", times.year_of(F.col("u")))
    assert row.first() == ("2024-03", "unknown", "2024", "unknown")


def test_bounds_are_strict():
    assert times.parse_bound(None) is None
    assert times.parse_bound("2024-01-02 03:04:05") == datetime(2024, 1, 2, 3, 4, 5)
    for bad in ("soon", "2024-13-01", "2024-01-01T00:00:00+02:00"):
        with pytest.raises(ValueError):
            times.parse_bound(bad)


def test_strip_and_numbers(spark):
    values = ["   mara\t\x1f", "5 replies", "1,234 replies", "none", "99999999999999 replies"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select(text.strip(F.col("v")), text.first_number(F.col("v"))).collect()
    assert rows[0][0] == values[0].strip() == "mara"
    assert [r[1] for r in rows] == [0, 5, 1, 0, 2**31 - 1]


def test_json_quote(spark):
    import json

    values = ["plain", 'quo"te', "back\\slash", "tab\tnew\nline", "ü 😀", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(text.json_quote(F.col("v"))).collect()]
    assert got == [json.dumps(v, ensure_ascii=False) for v in values]


def test_weekday_labels_name_no_day(spark):
    labels = ["Monday at 3:14 PM", "Today at 3:14 PM", "yesterday 15:14", "3:14 PM", "at 15:14"]
    df = spark.createDataFrame([(i, label, datetime(2024, 7, 4, 8)) for i, label in enumerate(labels)], "i int, label string, captured timestamp")
    rows = df.select("i", times.label_datetime(F.col("label"), F.col("captured")).alias("t")).orderBy("i").collect()
    assert [r.t and r.t.day for r in rows] == [None, 4, 3, 4, 4]


def test_labels_are_dealt_before_they_are_parsed(spark, tmp_path):
    """One file is read by one task; without an exchange that task would parse every label."""
    events = "SELECT id AS event_id, timestamp_seconds(1704067200 + id) AS ts, id AS user_id, 'view' AS event_type, 1.0D AS value, '{}' AS props FROM range(64)"
    spark.sql(events).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    dates = QUERIES["label_dates"](spark, str(tmp_path))
    assert "REPARTITION_BY_COL" in dates._jdf.queryExecution().executedPlan().toString()
    assert dates.filter("moment IS NOT NULL").count() == 64 * 8


@pytest.mark.parametrize("label, hour", [("Mar 7, 2024 12:05 AM", 0), ("Mar 7, 2024 12:05pm", 12), ("Mar 7, 2024 13:05 pm", None), ("Mar 7, 2024 0:05 am", None), ("Mar 7, 2024 24:05", None)])
def test_hours_of_a_clock(spark, label, hour):
    found = spark.range(1).select(times.label_datetime(F.lit(label)).alias("t")).first().t
    assert found == (None if hour is None else datetime(2024, 3, 7, hour, 5))
