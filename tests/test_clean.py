import random

import pytest
from pyspark.sql import functions as F

from palaver.operators import clean
from palaver.plans import export as plans


def ids(df):
    return sorted(r["timestamp"] for r in df.collect())


def micros(text):
    from datetime import datetime, timezone

    return str(int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1_000_000 + 0.5))


def test_first_seen_ignores_input_order(spark, message_table):
    rows = [{"timestamp": f"t{i % 7}", "seq": i, "text": f"copy {i}"} for i in range(70)]
    expected = {f"t{i}": f"copy {i}" for i in range(7)}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        kept = clean.first_seen(message_table(*rows).repartition(5))
        assert {r["timestamp"]: r["text"] for r in kept.collect()} == expected


def test_first_seen_limits_copies_before_the_exchange(spark, message_table):
    plan = clean.first_seen(message_table({}))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_same_id_in_two_channels_stays(message_table):
    kept = clean.first_seen(message_table({"timestamp": "1"}, {"timestamp": "1", "channel": "other"}))
    assert kept.count() == 2


def test_search_keeps_every_hit_without_id(message_table):
    kept = clean.first_hits(message_table({"timestamp": ""}, {"timestamp": ""}, {"timestamp": "1"}, {"timestamp": "1"}))
    assert ids(kept) == ["", "", "1"]


def test_channel_mode_drops_messages_without_id(message_table):
    assert ids(clean.with_ids(message_table({"timestamp": ""}, {"timestamp": "1"}))) == ["1"]


def test_bounds_are_asymmetric_and_pass_undated(message_table):
    stamps = {
        "before": micros("2024-01-05 11:59:59"),
        "at": micros("2024-01-05 12:00:00"),
        "last": micros("2024-01-09 23:59:59.999999"),
        "after": micros("2024-01-10 00:00:00"),
    }
    rows = [{"timestamp": t} for t in stamps.values()]
    rows += [{"timestamp": "undated"}, {"timestamp": "x", "datetime": "Jan 5, 2024 11:00 AM"}, {"timestamp": "y", "datetime": "Jan 9, 2024"}]
    kept = clean.date_bounds(message_table(*rows), "2024-01-05 12:00:00", "2024-01-09 08:00:00")
    assert ids(kept) == sorted([stamps["at"], stamps["last"], "undated", "y"])


def test_other_months_are_not_read(spark, message_table, tmp_path):
    rows = message_table(*[{"timestamp": t} for t in (micros("2024-01-31 10:00:00"), micros("2024-02-01 10:00:00"), micros("2024-03-01 10:00:00"), "u")])
    from palaver.operators import summary

    summary.with_month(rows).write.partitionBy("month").parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    kept = plans.clean_messages(stored, None, "2024-02-01", "2024-02-28", stored_month="month")
    assert ids(kept) == ids(plans.clean_messages(rows, None, "2024-02-01", "2024-02-28")) == [micros("2024-02-01 10:00:00"), "u"]
    scan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((month" in scan


def test_bounds_are_validated(message_table):
    with pytest.raises(ValueError):
        clean.date_bounds(message_table({}), "2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        clean.date_bounds(message_table({}), "whenever")
    with pytest.raises(ValueError):
        plans.require_scope([], None, None)
    plans.require_scope(["general"], None, None)


def test_filtered_first_copy_is_not_replaced_by_a_later_one(message_table):
    rows = message_table({"timestamp": "1", "is_bot": True, "seq": 0}, {"timestamp": "1", "is_bot": False, "seq": 1})
    assert plans.clean_messages(rows, exclude_bots=True).count() == 0


def test_date_filter_moves_below_the_exchange(message_table):
    df = plans.clean_messages(message_table({}), oldest="2024-01-01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "timestamp_micros" in plan[plan.index("Exchange hashpartitioning") :]


def test_keywords(message_table):
    rows = message_table({"text": "Fix the BUILD", "timestamp": "1"}, {"text": "the fix", "timestamp": "2"})
    assert ids(rows.filter(clean.keyword_match(F.col("text"), " build  fix"))) == ["1"]
    with pytest.raises(ValueError):
        clean.keyword_match(F.col("text"), "  ")


def test_select_channels(message_table, spark):
    rows = message_table(*[{"channel": c, "timestamp": c} for c in "abc"])
    assert ids(clean.select_channels(rows, ["a", "b"])) == ["a", "b"]
    assert ids(clean.select_channels(rows, exclude=["a"])) == ["b", "c"]
    assert ids(clean.select_channels(rows, spark.createDataFrame([("c",)], "channel string"))) == ["c"]


def test_search_export(message_table):
    rows = message_table(
        {"channel": "a", "timestamp": "1", "text": "release notes of today"},
        {"channel": "b", "timestamp": "1", "text": "RELEASE", "is_bot": True},
        {"channel": "b", "timestamp": "2", "text": "nothing"},
    )
    export = plans.search_export(rows, "release", exclude_bots=True)
    row = export.messages.first()
    assert (row["channel"], row["source_channel"]) == ("search_release", "a")
    assert export.parents.count() == 0 and export.standalone.count() == 1
    assert plans.search_name("x" * 30) == "search_" + "x" * 20
