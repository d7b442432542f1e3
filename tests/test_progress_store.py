from functools import reduce

from palaver.operators import progress as operators
from palaver.schema import EXPANDED, PROGRESS
from palaver.sources import progress_store as store


def save(spark, channel, count, when, run="r1", status="in_progress"):
    row = (run, "", channel, status, str(count), count, None, when, when, "json")
    return spark.createDataFrame([row], PROGRESS)


def state(df):
    return sorted((r.export_id, r.channel, r.status, r.message_count) for r in df.collect())


def test_compaction_changes_nothing(spark, tmp_path):
    path, saves = str(tmp_path), []
    assert store.read(spark, path).count() == 0
    for turn in range(4):
        for rows in (save(spark, "a", turn, f"2024-01-0{turn + 1}"), save(spark, "b", 9 - turn, f"2024-01-0{9 - turn}", run="r2")):
            store.append(path, rows)
            saves.append(rows)
        expected = state(operators.latest(reduce(lambda x, y: x.unionByName(y), saves)))
        assert state(store.read(spark, path)) == expected
        if turn % 2:
            store.compact(spark, path)
            assert state(store.read(spark, path)) == expected
            assert store.stored_rows(spark, path).first().n == 2
    assert operators.status(store.read(spark, path)).count() == 2


def test_broken_compaction_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    store.append(path, save(spark, "a", 1, "2024-01-01"))
    store.compact(spark, path)
    store.append(path, save(spark, "a", 2, "2024-01-02", status="completed"))
    before = state(store.read(spark, path))
    store._snapshot(spark, path)  # written, but no version names it
    assert state(store.read(spark, path)) == before == [("r1", "a", "completed", 2)]
    assert store.stored_rows(spark, path).first().n == 2
    store.compact(spark, path)
    assert state(store.read(spark, path)) == before
    assert store.stored_rows(spark, path).first().n == 1


def test_expanded_threads_are_kept_once(spark, tmp_path):
    path = str(tmp_path)
    threads = spark.createDataFrame([("r1", "a", "5"), ("r1", "a", "6")], EXPANDED)
    store.append(path, save(spark, "a", 1, "2024-01-01"), threads)
    store.compact(spark, path)
    store.append(path, save(spark, "a", 2, "2024-01-02"), threads.limit(1))
    assert sorted(r.parent_ts for r in store.read_expanded(spark, path).collect()) == ["5", "6"]
