import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palaver.operators import summary, threads
from palaver.plans import export as plans
from palaver.sources import adapters


def users(replies):
    return [r["user"] for r in replies]


def ladder_thread(export):
    return export.nested_threads().filter("parent.user = 'ruben'").first()


def test_nesting_keeps_panel_order(market):
    row = ladder_thread(plans.channel_export(*market))
    assert users(row["replies"]) == ["olga", "pim", "tally"]  # by place, not by time
    assert (row["reply_count"], row["n_replies"], row["page"]) == (3, 3, 0)


def test_declared_count_survives_bot_filter(market):
    row = ladder_thread(plans.channel_export(*market, exclude_bots=True))
    assert users(row["replies"]) == ["olga", "pim"] and row["reply_count"] == 3 and row["n_replies"] == 2


def test_thread_of_bots_only_stays_a_thread(message_table, reply_table):
    export = plans.channel_export(
        message_table({"timestamp": "1", "reply_count": 1}), reply_table({"parent_ts": "1", "is_bot": True}), exclude_bots=True
    )
    row = export.nested_threads().first()
    assert row["replies"] == [] and row["reply_count"] == 1 and export.standalone.count() == 0


def test_bot_parent_removes_its_thread(message_table, reply_table):
    export = plans.channel_export(
        message_table({"timestamp": "1", "reply_count": 1, "is_bot": True}), reply_table({"parent_ts": "1"}), exclude_bots=True
    )
    assert export.nested_threads().count() == export.replies.count() == export.messages.count() == 0


def test_replies_are_neither_bounded_nor_distinct(message_table, reply_table):
    twice = [{"parent_ts": "1718452800000000", "pos": p, "timestamp": "1"} for p in (1, 2)]
    export = plans.channel_export(
        message_table({"timestamp": "1718452800000000", "reply_count": 9}), reply_table(*twice), oldest="2024-06-01", newest="2024-06-30"
    )
    assert export.nested_threads().first()["n_replies"] == 2


def test_unexpanded_threads_are_standalone(market):
    export = plans.channel_export(*market, expand_threads=False)
    assert export.standalone.count() == 4 and export.parents.count() == 0 and export.replies.count() == 0


def test_reply_count_falls_back_to_replies_found(spark):
    df = spark.createDataFrame([(0, 1), (5, 2), (None, 3)], "declared int, found int")
    assert [r[0] for r in df.select(threads.declared_or_found(F.col("declared"), F.col("found"))).collect()] == [1, 5, 3]


@pytest.mark.parametrize("page_size", [1, 7, 1000])
def test_long_threads_continue_in_pages(message_table, reply_table, page_size):
    """A hot thread holding most rows, one with gaps in front, one without replies."""
    hot = [{"parent_ts": "1", "pos": p, "user": f"u{p}"} for p in range(1, 101)]
    late = [{"parent_ts": "2", "pos": p, "user": f"u{p}"} for p in range(50, 60)]
    parents = message_table(*[{"timestamp": t, "reply_count": 1} for t in "123"])
    rows = threads.nest(parents, reply_table(*hot, *late), page_size).collect()
    assert all(len(r["replies"]) <= page_size for r in rows)
    for ts, expected in (("1", hot), ("2", late), ("3", [])):
        pages = sorted((r for r in rows if r["parent"]["timestamp"] == ts), key=lambda r: r["page"])
        assert [u for r in pages for u in users(r["replies"])] == [e["user"] for e in expected]
        assert {r["n_replies"] for r in pages} == {len(expected)}


def test_messages_are_threads_or_standalone(market):
    export = plans.channel_export(*market)
    assert export.parents.count() + export.standalone.count() == export.messages.count() == 4
    difference = threads.standalone_without(*market)
    assert sorted(r["user"] for r in difference.collect()) == ["nadia", "olga", "tally"]


def test_reply_counts_from_replies(market):
    counted = threads.with_reply_counts(*market)
    assert {r["user"]: r["reply_count"] for r in counted.collect()} == {"nadia": 0, "ruben": 3, "tally": 0, "olga": 0}


def test_depth_limit(reply_table):
    replies = reply_table(*[{"parent_ts": t, "pos": p} for t in "12" for p in (9, 4, 5)])
    kept = threads.limit_depth(replies, 2).collect()
    assert sorted((r["parent_ts"], r["pos"]) for r in kept) == [("1", 4), ("1", 5), ("2", 4), ("2", 5)]


def test_month_split(message_table):
    def stamp(day):
        return str(1704067200 + day * 86400) + "000000"

    rows = message_table(
        {"channel": "studio", "timestamp": stamp(14), "reply_count": 1},
        {"channel": "studio", "timestamp": stamp(19)},
        {"channel": "studio", "timestamp": stamp(161)},
        {"channel": "studio", "timestamp": "not-a-timestamp"},
    )
    totals = summary.month_totals(summary.with_month(rows)).collect()
    assert {r["month"]: (r["n_threads"], r["n_standalone"], r["total_messages"]) for r in totals} == {
        "2024-01": (1, 1, 2),
        "2024-06": (0, 1, 1),
        "unknown": (0, 1, 1),
    }
    assert sum(r["total_messages"] for r in totals) == rows.count()


def test_channel_metadata(spark, message_table):
    totals = summary.channel_totals(message_table({"channel": "a"}))
    meta = spark.createDataFrame(
        [("a", 0, "completed", "s1", "f1"), ("a", 1, "pending", "s2", "f2"), ("empty", 2, "completed", "", "")],
        "channel string, channel_pos int, status string, export_started string, export_finished string",
    )
    kept = {r["channel"]: (r["status"], r["export_started"], r["total_messages"]) for r in summary.attach_channels(totals, meta, True).collect()}
    assert kept == {"a": ("completed", "s1", 1), "empty": ("completed", "", 0)}
    assert summary.attach_channels(totals, meta, False).count() == 1


def test_replies_without_a_place_or_before_the_first_page(message_table, reply_table):
    """Replies without a place stand on page 0, negative places on a page of their own; none is lost."""
    parents = message_table(*[{"timestamp": t, "reply_count": 1} for t in "12"])
    odd = [{"parent_ts": "1", "pos": p, "user": f"u{p}"} for p in (None, -1, 3, 12)] + [{"parent_ts": "2", "pos": None, "user": "uNone"}]
    rows = threads.nest(parents, reply_table(*odd), 10).collect()
    found = sorted((r["parent"]["timestamp"], r["page"], users(r["replies"]), r["n_replies"]) for r in rows)
    assert found == [("1", -1, ["u-1"], 4), ("1", 0, ["uNone", "u3"], 4), ("1", 1, ["u12"], 4), ("2", 0, ["uNone"], 1)]


def test_lines_are_dealt_by_order_only(spark):
    """Lines made distinct stay where they meet their order; dealt by line number they would be exchanged again."""
    for df in _order_threads(spark):
        dealt = re.findall(r"hashpartitioning\((.*?)\)", df._jdf.queryExecution().executedPlan().toString())
        assert any(keys.startswith("l_orderkey") for keys in dealt) and not any("l_linenumber" in keys for keys in dealt)


def test_counts_of_orders_that_share_an_id(spark):
    """An order listed twice counts its lines twice; a null key or date has no replies."""
    top, replies = _order_threads(spark)
    declared = sorted((r["seq"] or 0, r["timestamp"] or "", r["reply_count"]) for r in top.collect())
    assert [(k, n) for k, _, n in declared] == [(0, 0), (1, 3), (2, 0), (3, 2), (3, 2), (4, 0)]
    assert replies.count() == 2 + 1 + 2 + 1


def _order_threads(spark):
    day = datetime(1995, 1, 2)
    orders = [(1, day), (2, day), (3, day), (3, day), (4, None), (None, day)]
    frame = spark.createDataFrame(
        [(k, 7, "O", d, "1-URGENT") for k, d in orders],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string",
    )
    lines = [(1, 1), (1, 1), (1, 2), (1, None), (3, 1), (4, 1), (9, 1)]
    lineitem = spark.createDataFrame(
        [(k, 10 + i, 20 + i, n, 1.0, 2.0, "F", day + timedelta(days=i)) for i, (k, n) in enumerate(lines)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_linestatus string, l_shipdate timestamp",
    )
    return adapters.threads_from_orders(frame, lineitem)
