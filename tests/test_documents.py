import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from palaver.functions import render
from palaver.operators import threads
from palaver.plans import export as plans
from palaver.plans import layout as lay
from palaver.sinks import rows as row_sink
from palaver.sinks import text as text_sink

LADDER_MD = "**ruben** — 2 Mar 2024, 11:00\n\nWho has the ladder?\n\nReactions: :eyes: (1) :heart: (12)\n"
ANSWERS_MD = (
    "> **olga** — noon\n\n> Not me\n\n> **pim**\n\n> Wait\n> \n> here\n\n> Reactions: :+1: (2)\n"
    "\n> **tally** (bot)\n\n> back at \"5\" \\ é\n\n> > [Attachment] rung\n"
)
THREAD_MD = LADDER_MD + "\n  *3 replies:*\n\n" + ANSWERS_MD + "\n---\n"
LOST_MD = "**olga**\n\n\n"
STALL_MD = "**nadia**\n\nStall 14 opens late\n\n> [Attachment] " + "x" * 100 + "\n> [Attachment] map\n> [Attachment] \n"
TALLY_MD = "**tally** (bot)\n\n3 < 5 & so on\n\nend\n"


@pytest.fixture
def export(market):
    return plans.channel_export(*market, channels=["market", "closed"]).dated("https://stalls", "2024-04-02T07:30:00")


def message(user, text, timestamp, datetime="", reactions=(), is_bot=False, attachments=()):
    named = [{"emoji": emoji, "count": count} for emoji, count in reactions]
    return {"user": user, "text": text, "timestamp": timestamp, "datetime": datetime, "reactions": named, "is_bot": is_bot, "attachments": list(attachments)}


def channel(name, threads, standalone, total):
    return {"channel": name, "status": "completed", "export_started": "", "export_finished": "", "total_messages": total, "threads": threads, "standalone_messages": standalone}


def expected_json():
    ladder = message("ruben", "Who has the ladder?", "1709373600000001", "2 Mar 2024, 11:00", [("eyes", 1), ("heart", 12)])
    answers = [
        message("olga", "Not me", "1709380000", "noon"),
        message("pim", "Wait\n\nhere", "1709373900000000", reactions=[("+1", 2)]),
        message("tally", 'back at "5" \\ é', "1709373700000000", is_bot=True, attachments=["rung"]),
    ]
    threads = [{"parent": ladder, "replies": answers, "reply_count": 3}, {"parent": message("olga", "", "1712000000"), "replies": [], "reply_count": 1}]
    standalone = [
        message("nadia", "Stall 14 opens late", "1709287200", attachments=["x" * 130, "map", ""]),
        message("tally", "3 < 5 & so on\n\nend", "1709294400000000", is_bot=True),
    ]
    channels = [channel("market", threads, standalone, 4), channel("closed", [], [], 0)]
    return {"workspace": "https://stalls", "export_date": "2024-04-02T07:30:00", "format_version": "1.0", "channels": channels}


def ordered(blocks):
    return "\n".join(r["text"] for r in blocks.orderBy(*lay.SORT_KEY).collect())


def test_message_text(market):
    texts = [r["t"] for r in market[0].orderBy("seq").select(render.message(threads.message_struct()).alias("t")).collect()]
    assert texts == [STALL_MD, LADDER_MD, TALLY_MD, LOST_MD]


def test_thread_text(export):
    nested = export.nested_threads().orderBy("parent.timestamp").select(render.thread(F.col("parent"), F.col("replies")))
    assert [r[0] for r in nested.collect()] == [THREAD_MD, LOST_MD + "\n---\n"]


def test_thread_without_replies(message_table, reply_table):
    export = plans.channel_export(message_table({"timestamp": "1", "reply_count": 3}), reply_table())
    assert export.nested_threads().select(render.thread(F.col("parent"), F.col("replies"))).first()[0] == "**mara**\n\nhi\n\n---\n"


def test_markdown_document(export):
    text = ordered(lay.markdown_blocks(export, lay.lay_out(export), "Chat"))
    assert text == "\n".join([
        "# Chat — https://stalls", "*Exported: 2024-04-02T07:30:00*", "",
        "## #market", "*4 messages | Status: completed*", "",
        THREAD_MD, LOST_MD, "---", "", "### Other Messages", "", STALL_MD, "---", "", TALLY_MD, "---", "",
        "## #closed", "*0 messages | Status: completed*", "",
    ])


def test_json_document(export):
    assert ordered(lay.json_blocks(export, lay.lay_out(export))) == json.dumps(expected_json(), indent=2, ensure_ascii=False)


def test_json_document_without_channels(message_table, reply_table):
    export = plans.channel_export(message_table(), reply_table()).dated("test", "2025-01-01")
    data = json.loads(ordered(lay.json_blocks(export, lay.lay_out(export))))
    assert data == {"workspace": "test", "export_date": "2025-01-01", "format_version": "1.0", "channels": []}


def test_search_document_with_equal_ids(message_table):
    rows = message_table(*[{"channel": c, "timestamp": t, "text": "hit"} for c in "ab" for t in ("1", "", "")])
    data = json.loads(ordered(lay.json_blocks(*(lambda e: (e, lay.lay_out(e)))(plans.search_export(rows, "hit")))))
    assert len(data["channels"][0]["standalone_messages"]) == 6


def read_document(folder):
    parts = sorted(glob.glob(f"{folder}/part-*"))
    return "".join(open(p, encoding="utf-8").read() for p in parts)


def test_written_documents(export, tmp_path):
    assert text_sink.write_json(export, str(tmp_path / "j"), date="20240402")
    (folder,) = glob.glob(f"{tmp_path}/j/stem=*")
    assert os.path.basename(folder) == "stem=market_closed_20240402.json"
    assert json.loads(read_document(folder)) == expected_json()
    assert text_sink.write_markdown(export, str(tmp_path / "m"), split_by="month", title="Chat")
    march, april = sorted(glob.glob(f"{tmp_path}/m/year=2024/stem=*"))
    assert march.endswith("stem=market_2024-03.md") and april.endswith("stem=market_2024-04.md")
    assert THREAD_MD in read_document(march) and "#closed" not in read_document(march)
    assert LOST_MD in read_document(april) and "ladder" not in read_document(april)


def test_html_and_plain_documents(export):
    page = ordered(lay.html_blocks(export, lay.lay_out(export), "Chat & more"))
    assert page.startswith('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>Chat &amp; more</title>')
    head = '<article id="1709373600000001"><p><b>ruben</b> — 2 Mar 2024, 11:00</p><p>Who has the ladder?</p><p>Reactions: :eyes: (1) :heart: (12)</p>'
    assert head + "\n<blockquote>" in page
    assert "<p>Wait<br><br>here</p>" in page and "back at &quot;5&quot;" in page and "<p>3 &lt; 5 &amp; so on" in page
    assert "<ul><li>" + "x" * 130 + "</li><li>map</li><li></li></ul>" in page
    assert page.count("<article") == page.count("</article>") == 4
    assert page.count("<section>") == page.count("</section>") == 2 and page.endswith("</body></html>")
    text = ordered(lay.plain_blocks(export, lay.lay_out(export), "Chat"))
    assert text.split("\n") == [
        "Chat - https://stalls - 2024-04-02T07:30:00", "#market (4 messages)",
        "ruben [2 Mar 2024, 11:00]: Who has the ladder?", "    olga [noon]: Not me", "    pim: Wait", "      ", "      here",
        '    tally (bot): back at "5" \\ é', "olga: ", "nadia: Stall 14 opens late", "tally (bot): 3 < 5 & so on", "  ", "  end",
        "#closed (0 messages)",
    ]


def test_other_sinks_and_default_date(export, tmp_path):
    from datetime import datetime

    assert text_sink.write_html(export, str(tmp_path / "h")) and text_sink.write_plain(export, str(tmp_path / "p"))
    today = datetime.now().strftime("%Y%m%d")
    assert glob.glob(f"{tmp_path}/h/stem=*")[0].endswith(f"stem=market_closed_{today}.html")
    assert glob.glob(f"{tmp_path}/p/stem=*")[0].endswith(f"stem=market_closed_{today}.txt")


def test_large_document_is_cut_and_stays_in_order(spark, message_table, reply_table, tmp_path):
    """One thread holds most rows: its replies land in several part files, in order."""
    parent = "1709373600000001"
    replies = reply_table(*[{"parent_ts": parent, "pos": p, "text": f"reply {p}"} for p in range(1, 3001)])
    export = plans.channel_export(message_table({"timestamp": parent, "reply_count": 3000}), replies)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text_sink.write_json(export, str(tmp_path / "j"), date="d")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    (folder,) = glob.glob(f"{tmp_path}/j/stem=*")
    assert len(glob.glob(f"{folder}/part-*")) > 1
    data = json.loads(read_document(folder))
    assert [r["text"] for r in data["channels"][0]["threads"][0]["replies"]] == [f"reply {p}" for p in range(1, 3001)]


def test_empty_split_writes_nothing(message_table, reply_table, tmp_path):
    export = plans.channel_export(message_table(), reply_table())
    assert text_sink.write_markdown(export, str(tmp_path / "m"), split_by="month") is False
    assert glob.glob(f"{tmp_path}/m/**/part-*", recursive=True) == []
    with pytest.raises(ValueError):
        lay.lay_out(export, "week")


def test_names_of_many_channels(message_table, reply_table):
    rows = message_table(*[{"channel": c, "timestamp": "1717243200000000"} for c in ("b", "a/x", "d", "c")])
    wanted = plans.channel_export(rows, reply_table(), ["d", "c", "b", "a/x"])
    names = lay.stems(lay.lay_out(wanted).documents, "{channel}-{date}", "20240601", ".md")
    assert names.first()["stem"] == "d_c_b_+1-20240601.md"
    monthly = lay.stems(lay.lay_out(plans.channel_export(rows, reply_table()), "month").documents, suffix=".json")
    assert monthly.first()["stem"] == "a_x_b_c_+1_2024-06.json"
    nothing = lay.stems(lay.lay_out(plans.channel_export(message_table(), reply_table())).documents, date="d", suffix=".md")
    assert nothing.first()["stem"] == "export_d.md"


def test_json_lines(export, spark, tmp_path):
    row_sink.write_json_lines(export, str(tmp_path))
    want = expected_json()["channels"][0]
    records = lambda name, by: sorted((json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/{name}").select("value").collect()), key=by)
    assert records("threads", lambda r: r["parent"]["timestamp"]) == want["threads"]
    assert records("standalone", lambda r: r["timestamp"]) == want["standalone_messages"]
    assert {r["channel"]: r["total_messages"] for r in records("channels", str)} == {"market": 4, "closed": 0}
    assert records("manifest", str) == [{k: v for k, v in expected_json().items() if k != "channels"}]
    assert all(os.path.isdir(f"{tmp_path}/threads/year=2024/month=2024-{m}") for m in ("03", "04"))


def test_xml_rows(export, spark, tmp_path):
    row_sink.write_xml(export, str(tmp_path))
    back = spark.read.format("xml").option("rowTag", "thread").load(f"{tmp_path}/threads")
    assert sorted((r["parent"]["user"], r["reply_count"]) for r in back.collect()) == [("olga", 1), ("ruben", 3)]


def test_compressed_rows(export, spark, tmp_path):
    row_sink.write_json_lines(export, f"{tmp_path}/json", compression="gzip")
    row_sink.write_xml(export, f"{tmp_path}/xml", compression="gzip")
    files = [name for folder, _, names in os.walk(tmp_path) for name in names if "threads" in folder and name.startswith("part-")]
    assert files and all(name.endswith(".gz") for name in files)
    assert spark.read.text(f"{tmp_path}/json/threads").count() == 2
    assert spark.read.format("xml").option("rowTag", "thread").load(f"{tmp_path}/xml/threads").count() == 2


def test_a_second_export_keeps_the_first(spark, message_table, reply_table, tmp_path):
    def write(month, *rows):
        monthly = plans.channel_export(message_table(*rows), reply_table(), channels=["general"]).dated("w", "d")
        row_sink.write_json_lines(monthly, f"{tmp_path}/rows")
        return text_sink.write_markdown(monthly, f"{tmp_path}/md", split_by="month")

    assert write("01", {"timestamp": "1704067200000000", "text": "in January"})
    assert write("02", {"timestamp": "1706745600000000", "text": "in February"})
    assert write("02", {"timestamp": "1706745600000000", "text": "in February again"})
    assert not write("03")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/md").collect())
    assert "in January" in text and "in February again" in text and "in February\n" not in text
    assert spark.read.text(f"{tmp_path}/rows/standalone").count() == 2


def test_null_user_text_and_bot_flag(spark, message_table, reply_table):
    rows = message_table({"timestamp": "1", "user": None, "text": "precious", "is_bot": None}, {"timestamp": "2", "text": None})
    kept = plans.channel_export(rows, reply_table(), exclude_bots=True).messages
    assert kept.count() == 2
    shown = kept.orderBy("timestamp").select(render.message(threads.message_struct()), render.html_message(threads.message_struct()), render.plain_message(threads.message_struct()))
    first, second = shown.collect()
    assert all("Unknown" in x and "precious" in x for x in first) and all(x and "mara" in x for x in second)


def test_month_of_labels_read_with_the_capture_time(spark, message_table, reply_table):
    rows = message_table({"timestamp": "x", "datetime": "Today at 9:15 AM"}).withColumn("captured_at", F.lit("2024-03-05 12:00:00").cast("timestamp"))
    export = plans.channel_export(rows, reply_table(), captured_at="captured_at", oldest="2024-03-01")
    assert [r["month"] for r in lay.lay_out(export, "month").heads.collect()] == ["2024-03"]
    assert [r["month"] for r in row_sink.message_records(export).collect()] == ["2024-03"]
