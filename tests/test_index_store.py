"""A stored index after additions, removals and merges against one built anew, and pruned rankings against full ones."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palaver.operators import index_store as store
from palaver.operators import search_index

WORDS = "anchor bell cliff dune ebb fog gull".split()


def text(i):
    """Every word at its own rate; every fortieth text has no word at all."""
    return "" if i % 40 == 7 else " ".join(WORDS[(i * j + j * j) % (2 + (i + j) % 6)] for j in range(1, 3 + (i * 7) % 30))


@pytest.fixture(scope="module")
def messages(spark):
    rows = [("ab"[i % 2], str(i), text(i)) for i in range(300)]
    return spark.createDataFrame(rows, "channel string, timestamp string, text string")


def part(messages, low, high):
    number = F.col("timestamp").cast("int")
    return messages.filter((number >= low) & (number < high))


def state(spark, path):
    rows = {(r.term, r.channel, r.timestamp, r.tf, r.length, tuple(r.positions)) for r in store.postings(spark, path).collect()}
    terms = {r.term: r.df for r in store.term_statistics(spark, path).collect()}
    return rows, terms, tuple(store.collection(spark, path).first()), sorted(map(tuple, store.documents(spark, path).collect()))


@pytest.fixture(scope="module")
def grown(spark, messages, tmp_path_factory):
    """Three additions, the second replacing a part of the first, then a removal; what is left is also built at once."""
    path, fresh = (str(tmp_path_factory.mktemp("index") / name) for name in ("grown", "fresh"))
    store.append(part(messages, 0, 120).withColumn("text", F.when(F.col("timestamp").cast("int") >= 100, "old text").otherwise(F.col("text"))), path, 8)
    store.append(part(messages, 100, 200), path, 8)
    store.append(part(messages, 200, 300), path, 8)
    gone = messages.filter(F.col("timestamp").cast("int") % 9 == 0)
    store.remove(gone, path)
    store.remove(spark.createDataFrame([("a", "unknown")], "channel string, timestamp string"), path)
    left = messages.filter(F.col("timestamp").cast("int") % 9 != 0)
    store.append(left, fresh, 8)
    return path, fresh, left


def test_grown_index_equals_a_rebuild(spark, grown):
    path, fresh, left = grown
    expected = set()
    for r in left.collect():
        words = re.findall(r"[^\W_]+", r.text.lower())
        for term in set(words):
            at = tuple(i for i, w in enumerate(words) if w == term)
            expected.add((term, r.channel, r.timestamp, len(at), len(words), at))
    rebuilt = state(spark, fresh)
    assert rebuilt[0] == expected and rebuilt[1] == Counter(term for term, *_ in expected)
    assert state(spark, path) == rebuilt


def test_merging_changes_nothing(spark, grown, messages):
    path, fresh, _ = grown
    before = state(spark, path)
    assert store.merge(spark, path, 4) == 0 and store.merge(spark, path, 3) == 3
    assert state(spark, path) == before == state(spark, fresh)
    assert len(store._segments(spark, path)) == 1
    store.append(part(messages, 0, 1), path)  # comes back after its removal
    assert store.documents(spark, path).filter("timestamp = '0'").count() == 1
    store.remove(part(messages, 0, 1), path)
    assert state(spark, path) == before


def test_broken_write_is_not_seen(spark, grown, messages, monkeypatch):
    path, _, _ = grown
    before = state(spark, path)
    with monkeypatch.context() as patched:
        patched.setattr(store, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.append(part(messages, 0, 50), path)
    assert state(spark, path) == before


@pytest.mark.parametrize("query,k", [("gull fog", 3), ("bell", 5), ("Dune, ebb anchor", 7), ("cliff absent", 1000), ("absent", 3)])
def test_pruned_ranking_equals_the_full_one(spark, grown, query, k):
    path, _, left = grown
    full = search_index.search(search_index.postings(left), left, query, limit=k).collect()
    assert [tuple(r) for r in store.top_k(spark, path, query, k).collect()] == [tuple(r) for r in full]
    read, held = store.blocks_scored(spark, path, query, k)
    assert read <= held
    if k < 6:
        assert read < held or held == 0


def test_phrases_and_nearness(spark, grown):
    path, _, left = grown
    found = {(r.channel, r.timestamp): r.n for r in store.phrase(spark, path, "Anchor anchor bell").collect()}
    close = {(r.channel, r.timestamp): r.n for r in store.near(spark, path, "bell", "cliff", 2).collect()}
    phrases, pairs = {}, {}
    for r in left.collect():
        words = r.text.split()
        n = sum(words[i : i + 3] == ["anchor", "anchor", "bell"] for i in range(len(words)))
        m = sum(w == "bell" and "cliff" in words[max(0, i - 2) : i + 3] for i, w in enumerate(words))
        phrases |= {(r.channel, r.timestamp): n} if n else {}
        pairs |= {(r.channel, r.timestamp): m} if m else {}
    assert found == phrases and phrases and close == pairs and pairs
    with pytest.raises(ValueError):
        store.near(spark, path, "bell", "Bell", 2)
    with pytest.raises(ValueError):
        store.phrase(spark, path, " - ")


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "none")
    assert store.top_k(spark, path, "bell").collect() == store.phrase(spark, path, "a b").collect() == []
    assert store.collection(spark, path).first() == (0, 0) and store.merge(spark, path) == 0


def test_lookup_reads_by_term(spark, grown):
    plan = store.postings(spark, grown[0]).filter(F.col("term") == "bell")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,bell)" in plan


def test_no_posting_is_exchanged(spark, messages, tmp_path, monkeypatch):
    """Texts are exchanged once; postings are not, neither for an addition, a replacement, a removal nor a merge."""
    plans = []
    write = store._write_segment, store._write_figures

    def seen(name, found):
        plans.append((name, found._jdf.queryExecution().executedPlan().toString()))

    def segment(session, found, path):
        seen("segment", found)
        return write[0](session, found, path)

    def figures(found, path, name, sign):
        seen("figures", found)
        return write[1](found, path, name, sign)

    monkeypatch.setattr(store, "_write_segment", segment)
    monkeypatch.setattr(store, "_write_figures", figures)
    path = str(tmp_path / "index")
    for low, high in ((0, 100), (80, 180), (180, 300)):
        store.append(part(messages, low, high), path, 8)
    store.remove(part(messages, 0, 10), path)
    assert store.merge(spark, path, 3) == 3
    added = [p for name, p in plans[:-2] if name == "segment"]
    assert len(added) == 3 and all(p.count("Exchange") == 1 and "text" in p for p in added)
    others = [p for name, p in plans if name == "figures"] + [plans[-2][1]]
    assert all(not [line for line in p.splitlines() if "Exchange" in line and "BroadcastExchange" not in line] for p in others)


def test_removals_name_documents_by_bits(spark, tmp_path):
    """All bits of a row of 64, the sign bit included, and more documents than one row has."""
    rows = [("c", f"{i:04}", f"word{i} all") for i in range(200)]
    messages = spark.createDataFrame(rows, "channel string, timestamp string, text string")
    path = str(tmp_path / "index")
    store.append(messages, path)
    for number in range(3):
        store.remove(messages.filter(F.col("timestamp").cast("int") % 4 == number), path)
    left = {r[1] for r in rows if int(r[1]) % 4 == 3}
    assert {r.timestamp for r in store.documents(spark, path).collect()} == left
    assert store.term_statistics(spark, path).filter("term = 'all'").first().df == len(left) == store.collection(spark, path).first().n
