import json

import pytest
from pyspark.sql import functions as F

from palaver import schema
from palaver.operators import clean, progress
from palaver.plans import export as plans
from palaver.plans import layout
from palaver.sinks import rows as row_sink
from palaver.sources import progress_files


@pytest.fixture
def saved(spark):
    rows = [
        ("cp1", "https://a", "general", "completed", "5", 10, None, "c", "2024-01-02T00:00:00.123456", "json"),
        ("cp1", "https://a", "random", "in_progress", "", 0, None, "c", "2024-01-02T00:00:00.123456", "json"),
        ("cp2", "https://b", "random", "completed", "7", 5, "query", "c", "2024-01-03T00:00:00", "json"),
    ]
    return spark.createDataFrame(rows, schema.PROGRESS)


def test_status_lists_finished_runs_too(saved):
    rows = progress.status(saved, updated_chars=19).collect()
    assert [(r["export_id"], r["channels"], r["is_complete"], r["updated"]) for r in rows] == [
        ("cp2", "1/1 completed", True, "2024-01-03T00:00:00"),
        ("cp1", "1/2 completed", False, "2024-01-02T00:00:00"),
    ]
    assert rows[0]["search_query"] == "query"


def test_one_run(saved):
    assert progress.for_run(saved, "cp1").count() == 2
    with pytest.raises(LookupError):
        progress.for_run(saved, "nonexistent")


def test_resume_modes(message_table, saved):
    rows = message_table(*[{"channel": c, "timestamp": t} for c in ("general", "random", "new") for t in ("4", "5", "6")])
    marks = progress.for_run(saved, "cp1")
    high = progress.after_high_water(rows, marks)
    assert sorted((r["channel"], r["timestamp"]) for r in high.collect()) == [("general", "6")] + [(c, t) for c in ("new", "random") for t in "456"]
    known = rows.filter("timestamp > '4'")
    assert {r["timestamp"] for r in progress.not_exported(rows, known).collect()} == {"4"}
    assert {r["channel"] for r in progress.skip_completed(rows, marks).collect()} == {"new", "random"}


def test_resumed_export_keeps_completed_channel_empty(message_table, reply_table, saved):
    from palaver.plans import layout

    rows = message_table({"channel": "general", "timestamp": "9"}, {"channel": "random", "timestamp": "9"})
    export = plans.channel_export(rows, reply_table(), ["general", "random"], progress=progress.for_run(saved, "cp1"), mode="high_water")
    heads = {r["channel"]: (r["total_messages"], r["status"]) for r in layout.lay_out(export).heads.collect()}
    assert heads == {"general": (0, "completed"), "random": (1, "completed")}
    with pytest.raises(ValueError):
        plans.channel_export(rows, reply_table(), mode="other")


def test_expanded_threads_are_a_set(spark, message_table):
    _, nothing = progress_files.empty(spark)
    parents = message_table({"timestamp": "1", "reply_count": 1}, {"timestamp": "2", "reply_count": 1})
    once = progress.add_expanded(nothing, parents.filter("timestamp = '1'"), "run")
    twice = progress.add_expanded(once, parents.filter("timestamp = '1'"), "run")
    assert twice.count() == 1
    assert [r["timestamp"] for r in progress.skip_expanded(parents, twice).collect()] == ["2"]


def test_rest_of_a_resumed_run(spark, market):
    export = plans.channel_export(*market)
    done = spark.createDataFrame([("run", "market", "1709373600000001"), ("run", "market", "1709287200")], schema.EXPANDED)
    rest = export.without_expanded(done)
    assert [r["user"] for r in rest.parents.collect()] == ["olga"] and rest.replies.count() == 0
    assert sorted(r["user"] for r in rest.standalone.collect()) == ["nadia", "tally"]


def test_rest_keeps_standalone_messages_and_totals(message_table, reply_table, spark):
    rows = message_table({"timestamp": "1", "reply_count": 1}, {"timestamp": "2"}, {"timestamp": "3"})
    export = plans.channel_export(rows, reply_table())
    done = spark.createDataFrame([("run", "general", "1"), ("run", "general", "2")], schema.EXPANDED)
    rest = export.without_expanded(done)
    assert rest.parents.count() == 0 and rest.standalone.count() == 2
    totals = row_sink.channel_records(rest).first()["record"]
    assert json.loads(totals)["total_messages"] == 3
    heads = layout.lay_out(rest).heads.collect()
    assert [(r["total_messages"], r["n_threads"], r["n_standalone"]) for r in heads] == [(3, 0, 2)]


def test_runs_do_not_mix(message_table, reply_table, spark):
    row = lambda run, status, mark, at: (run, "w", "general", status, mark, 1, None, at, at, "json")
    saves = spark.createDataFrame([row("r1", "completed", "8", "a"), row("r2", "pending", "3", "a"), row("r2", "pending", "5", "b")], schema.PROGRESS)
    rows = message_table(*[{"timestamp": str(i)} for i in range(1, 10)])
    left = plans.channel_export(rows, reply_table(), progress=saves, export_id="r2", mode="high_water").messages
    assert sorted(r["timestamp"] for r in left.collect()) == ["6", "7", "8", "9"]
    assert plans.channel_export(rows, reply_table(), progress=saves).messages.count() == 0
    with pytest.raises(LookupError):
        plans.channel_export(rows, reply_table(), progress=saves, export_id="r3")
    twice = saves.filter("export_id = 'r1'")
    assert progress.status(twice.unionByName(twice.withColumn("updated_at", F.lit("b")))).first()["channels"] == "1/1 completed"


def test_saving_another_run_keeps_the_first(spark, saved, tmp_path):
    _, nothing = progress_files.empty(spark)
    for run in ("cp1", "cp2"):
        progress_files.write_documents(saved.withColumn("export_id", F.lit(run)).dropDuplicates(["channel"]), nothing, str(tmp_path / "p"))
    found = progress_files.progress(progress_files.read_documents(spark, str(tmp_path / "p")))
    assert {r["export_id"] for r in found.collect()} == {"cp1", "cp2"}


def test_newest_save_counts(saved, spark):
    later = saved.filter("channel = 'random' and export_id = 'cp1'").withColumn("updated_at", F.lit("2024-02-01")).withColumn("status", F.lit("completed"))
    rows = progress.latest(saved.unionByName(later)).filter("export_id = 'cp1'").collect()
    assert {r["channel"]: r["status"] for r in rows} == {"general": "completed", "random": "completed"}


def test_high_water(message_table):
    rows = message_table({"timestamp": "10"}, {"timestamp": "9"})
    assert progress.high_water(rows).first() == ("general", "9", 2)


def test_saved_documents(spark, tmp_path):
    full = {
        "export_id": "ser1",
        "workspace_url": "https://x",
        "channels": {"general": {"status": "completed", "last_message_ts": "ts1", "message_count": 100, "expanded_threads": ["t1", "t2"]}, "new": {}},
        "search_query": None,
        "created_at": "a",
        "updated_at": "b",
        "format": "markdown",
    }
    (tmp_path / "ser1.json").write_text(json.dumps(full, indent=2))
    (tmp_path / "bare.json").write_text("{}")
    (tmp_path / "broken.json").write_text('{"export_id": "x", ')
    documents = progress_files.read_documents(spark, str(tmp_path), "*.json", lines=False)
    rows = {(r["export_id"], r["channel"]): r for r in progress_files.progress(documents).collect()}
    assert set(rows) == {("ser1", "general"), ("ser1", "new"), ("bare", None)}
    assert rows["ser1", "general"]["message_count"] == 100
    assert (rows["ser1", "new"]["status"], rows["ser1", "new"]["last_message_ts"]) == ("pending", "")
    assert rows["bare", None]["format"] == "json"
    status = {r["export_id"]: r["channels"] for r in progress.status(progress_files.progress(documents)).collect()}
    assert status == {"ser1": "1/2 completed", "bare": "0/0 completed"}
    assert sorted(r["parent_ts"] for r in progress_files.expanded(documents).collect()) == ["t1", "t2"]


@pytest.mark.parametrize("page_size", [3, 1000])
def test_documents_round_trip(spark, saved, tmp_path, page_size):
    expanded = spark.createDataFrame([("cp1", "general", f"t{i}") for i in range(40)], schema.EXPANDED)
    path = progress_files.write_documents(saved, expanded, str(tmp_path / "out"), page_size)
    documents = progress_files.read_documents(spark, path)
    assert (documents.count() > 2) == (page_size == 3)
    order = ["export_id", "channel"]
    assert progress_files.progress(documents).orderBy(order).collect() == saved.orderBy(order).collect()
    assert sorted(progress_files.expanded(documents).collect()) == sorted(expanded.collect())


def test_broken_documents_are_listed(spark, tmp_path):
    good, cut, typed = '{"export_id": "a", "channels": {"x": {"status": "completed"}}}', '{"export_id": "b", "chan', '{"export_id": "c", "channels": [1]}'
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "docs").write_text("\n".join([good, cut, "", typed, "7", good.replace('"a"', '"d"')]) + "\n")
    read = progress_files.read_documents(spark, str(tmp_path / "p"))
    assert sorted(r["export_id"] for r in read.collect()) == ["a", "d"] and read.count() == 2
    found = progress_files.rejected_documents(spark, str(tmp_path / "p"))
    assert found.count() == 3 and {r["content"]: (r["file"], r["reason"] == "no JSON") for r in found.collect()} == {cut: ("docs", True), typed: ("docs", False), "7": ("docs", False)}


def test_messages_without_id_are_listed(message_table):
    rows = message_table({"timestamp": "1"}, {"timestamp": ""}, {"timestamp": None})
    assert [r["seq"] for r in clean.rejected_messages(rows).orderBy("seq").collect()] == [1, 2] and clean.with_ids(rows).count() == 1
