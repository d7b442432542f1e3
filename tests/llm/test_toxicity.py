"""Toxicity: features by hand, held-out accuracy, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from palaver.llm import toxicity
from palaver.llm.common import held_out

RUDE = ["blorg", "snarfing", "grubber"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    words = [f"wa{i}le" for i in range(300)]
    rows, labels = [], []
    for i in range(500):
        body = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                body.insert(rng.randint(0, len(body)), rng.choice(RUDE) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(body), "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, "s"), (901, "", "s"), (902, "word " * 50_000, "s"), (None, "blorg blorg", "s")]
    labels += [(900, 1, None), (None, 1, 1), (0, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, features string")
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(tables):
    docs, labels = tables
    scored = toxicity.train(docs, labels).score(docs)
    assert scored.columns == [*docs.columns, "score"]
    rows = scored.withColumn("held", held_out(F.col("doc_id"))).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held and r.doc_id is not None and r.doc_id < 500]
    assert sum((r.score >= 0.5) == (r.doc_id % 5 == 0) for r in judged) / len(judged) > 0.97
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[900] < 0.5 and by_id[901] < 0.5 and by_id[902] < 0.5 and by_id[None] >= 0.5


def test_one_class_or_none_to_learn_from(spark, tables):
    docs, labels = tables
    assert {r.score for r in toxicity.train(docs, labels.filter("toxic = 0")).score(docs).collect()} == {0.0}
    assert {r.score for r in toxicity.train(docs, labels.limit(0)).score(docs).collect()} == {0.0}
    assert toxicity.train(docs.limit(0), labels.limit(0)).score(docs.limit(0)).count() == 0


def test_features_by_hand():
    kinds = toxicity.Kinds(frozenset({"blorg", "snar*"}))
    of = lambda text: dict(zip(toxicity.FEATURES, toxicity.features(text, kinds)))
    plain = of("You are a blorg, SNARKY b1org! b.l.o.r.g")
    assert plain["lexicon"] == 1 / 7 and plain["stems"] == 1 / 7 and plain["disguised"] == 2 / 7
    assert plain["near_second_person"] == 1 / 4 and plain["shouted"] == 1 / 7
    assert of("x b l o r g y z ok")["spaced"] > 0 and of("b l x")["spaced"] == 0
    assert of(None) == of("") == of("  ") == dict.fromkeys(toxicity.FEATURES, 0.0)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "_MEMO", 10)
    kinds = toxicity.Kinds(frozenset({"blorg"}))
    toxicity.features(" ".join(f"w{i}" for i in range(100)), kinds)
    assert len(kinds) <= 10
