import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.operators import importance, privacy, search_index, summary
from palaver.plans import export as plans

TEXTS = ["The build broke, the build!", "build notes", "café Ünïcode 42", "nothing else here", "the the the notes"]


@pytest.fixture
def documents(message_table):
    return message_table(*[{"timestamp": str(i), "text": t, "channel": "ab"[i % 2]} for i, t in enumerate(TEXTS)])


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_postings_against_brute_force(documents):
    got = {(r["term"], r["timestamp"]): (r["tf"], r["length"]) for r in search_index.postings(documents).collect()}
    expected = {}
    for i, text in enumerate(TEXTS):
        for term, n in Counter(words(text)).items():
            expected[term, str(i)] = (n, len(words(text)))
    assert got == expected


def test_search_against_brute_force(documents):
    query = "The build"
    mean = sum(len(words(t)) for t in TEXTS) / len(TEXTS)
    scores = {}
    for term in set(words(query)):
        holders = [i for i, t in enumerate(TEXTS) if term in words(t)]
        idf = math.log(1 + (len(TEXTS) - len(holders) + 0.5) / (len(holders) + 0.5))
        for i in holders:
            tf, length = words(TEXTS[i]).count(term), len(words(TEXTS[i]))
            scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    rows = search_index.search(search_index.postings(documents), documents, query, limit=2).collect()
    best = sorted(scores, key=lambda i: -scores[i])[:2]
    assert [int(r["timestamp"]) for r in rows] == best
    assert [r["score"] for r in rows] == pytest.approx([scores[i] for i in best], abs=1e-6)
    with pytest.raises(ValueError):
        search_index.search(search_index.postings(documents), documents, " , ")


def test_stored_index(spark, documents, tmp_path):
    search_index.write_index(search_index.postings(documents), str(tmp_path / "i"))
    stored = spark.read.parquet(str(tmp_path / "i"))
    assert search_index.search(stored, documents, "notes").count() == 2
    plan = stored.filter(F.col("term") == "notes")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,notes)]" in plan


def test_categories(documents):
    rows = search_index.categories(documents, {"ci": ["Build", "broke"], "doc": ["notes"]}).collect()
    assert {(r["category"], r["timestamp"]): r["hits"] for r in rows} == {("ci", "0"): 3, ("ci", "1"): 1, ("doc", "1"): 1, ("doc", "4"): 1}


def test_top_terms(documents):
    rows = search_index.top_terms(search_index.postings(documents), documents, k=1).collect()
    top = {r["channel"]: (r["term"], r["tf"]) for r in rows}
    assert top["a"] == ("the", 5) and len(rows) == 2


def test_privacy(message_table):
    text = "mail a.b+c@x-y.example.org or +1 (017) 555-7713, card 4111 1111 1111 1111, not 4111 1111 1111 1112; 10.0.0.255 not 10.0.0.256"
    df = message_table({"timestamp": "1", "text": text})
    got = {(r["kind"], r["value"], r["valid"]) for r in privacy.findings(df).collect()}
    assert got == {
        ("email", "a.b+c@x-y.example.org", True),
        ("phone", "+1 (017) 555-7713", True),
        ("card", "4111 1111 1111 1111", True),
        ("card", "4111 1111 1111 1112", False),
        ("ipv4", "10.0.0.255", True),
    }
    masked, removed = df.select(privacy.redact(F.col("text")), privacy.redact(F.col("text"), remove=True)).first()
    assert masked == "mail [EMAIL] or [PHONE], card [CARD], not [CARD]; [IPV4] not 10.0.0.256"
    assert removed == "mail  or , card , not ;  not 10.0.0.256"


def test_importance_and_metadata(market):
    rows = {r["user"]: r["importance"] for r in importance.score(*market).join(market[0].select("timestamp", "user"), "timestamp").collect()}
    assert rows == {"nadia": 0, "ruben": (1 + 12) + 2 * 3 + 3, "tally": 0, "olga": 0}
    export = plans.channel_export(*market)
    assert summary.run_metadata(export.parents, export.replies, export.standalone).first() == (1, 2, 3, 2)


def test_rank_equals_a_dense_solution(spark):
    # a loop, two nodes without links of their own, one that nobody links to, a repeated link, rows that are no link
    links = [("a", "b", 2), ("a", "c", 1), ("b", "a", 1), ("c", "c", 3), ("c", "d", 1), ("e", "a", 5), ("e", "f", 1), ("a", "b", 1), (None, "a", 1), ("d", "a", 0)]
    found = dict(map(tuple, importance.rank(spark.createDataFrame(links, "source string, target string, weight bigint"), tolerance=1e-8).collect()))
    names = "abcdef"
    matrix = np.zeros((6, 6))
    for source, target, weight in links[:8]:
        matrix[names.index(target), names.index(source)] += weight
    out = matrix.sum(axis=0)
    matrix = np.where(out > 0, matrix / np.maximum(out, 1), 1 / 6)
    expected = np.linalg.solve(np.eye(6) - 0.85 * matrix, np.full(6, 0.15 / 6))
    assert [found[n] for n in names] == pytest.approx(expected, abs=1e-7) and sum(found.values()) == pytest.approx(1)
    assert importance.rank(spark.createDataFrame([], "source string, target string, weight bigint")).count() == 0


def test_reply_links(market):
    rows = {tuple(r) for r in importance.reply_links(*market).collect()}
    assert rows == {("pim", "ruben", 1), ("olga", "ruben", 1), ("tally", "ruben", 1)}


def test_bank_numbers_and_addresses(message_table):
    texts = {
        "1": "send to GB82 WEST 1234 5698 7654 32, thanks",
        "2": "or GB82WEST12345698765433",
        "3": "host 2001:db8::ff00:42:8329 at 12:30:45",
        "4": "host 1:2:3:4:5:6:7:8, not 1:2:3:4:5:6:7",
        "5": "card 4111 1111 1111 1111, code AB12",
        "6": "NL91 ABNA 0417 1643 00 and card 4111-1111-1111-1112",
    }
    df = message_table(*[{"timestamp": i, "text": t} for i, t in texts.items()], {"timestamp": "7", "text": None})
    got = sorted((r.timestamp, r.kind, r.value, r.valid) for r in privacy.findings(df).collect())
    assert got == [
        ("1", "iban", "GB82 WEST 1234 5698 7654 32", True),
        ("2", "iban", "GB82WEST12345698765433", False),
        ("3", "ipv6", "2001:db8::ff00:42:8329", True),
        ("4", "ipv6", "1:2:3:4:5:6:7:8", True),
        ("5", "card", "4111 1111 1111 1111", True),
        ("6", "card", "4111-1111-1111-1112", False),
        ("6", "iban", "NL91 ABNA 0417 1643 00", True),
    ]
    masked = [r[0] for r in df.orderBy("timestamp").select(privacy.redact(F.col("text"))).collect()]
    assert masked[0] == "send to [IBAN], thanks" and masked[2] == "host [IPV6] at 12:30:45"


def test_postings_need_no_exchange(documents):
    plan = search_index.postings(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
