"""Quality: n-grams by hand, the fit against its optimum, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palaver.llm import quality


def buckets(text):
    grams, first = quality.ngrams(pa.array([text]))
    assert first.tolist() == [0, len(grams)]
    return set(grams.tolist())


def test_ngrams_by_hand():
    assert buckets(None) == buckets("") == set() and buckets(" \n") == set()
    assert len(buckets("ab")) == 1 and len(buckets("ab cd")) == 2 + 1 + 3
    twice, thrice = buckets("xx xx") & buckets("yy yy"), buckets("xx xx xx") & buckets("yy yy yy")
    assert len(twice) == 1 and len(thrice) == 2 and twice < thrice
    assert len(buckets("xx " * 8) & buckets("yy " * 8)) == 4
    together, first = quality.ngrams(pa.array(["aa aa", "aa", None, "bb aa"]))
    assert [set(together[a:b].tolist()) for a, b in zip(first[:-1], first[1:])] == [buckets("aa aa"), buckets("aa"), set(), buckets("bb aa")]


def test_log_ratios_by_hand():
    rows, signs = [np.array([1, 2]), np.array([2]), np.array([3])], np.array([1, 1, -1])
    ratios = quality.log_ratios(rows, signs)
    good, bad = quality.BUCKETS + 3, quality.BUCKETS + 1
    assert ratios[2] == pytest.approx(np.log((3 / good) / (1 / bad))) and ratios[3] == pytest.approx(np.log((1 / good) / (2 / bad)))


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    signs = np.where(x[:, 0] + 0.4 * rng.normal(size=60) > 0, 1, -1)
    rows = [(np.arange(5), v) for v in x]
    w, b, alpha = quality.dual_coordinate_descent(rows, signs, 5, cost=0.7, epochs=2000, tolerance=1e-9)
    primal = (w @ w + b * b) / 2 + 0.7 * np.maximum(0, 1 - signs * (x @ w + b)).sum()
    dual = alpha.sum() - (w @ w + b * b) / 2
    assert primal == pytest.approx(dual, rel=1e-6) and ((alpha >= 0) & (alpha <= 0.7)).all()
    assert np.allclose(w, (alpha * signs) @ x) and b == pytest.approx(float((alpha * signs).sum()))
    for _ in range(200):  # nothing near it is better
        v, c = w + rng.normal(scale=0.05, size=5), b + rng.normal(scale=0.05)
        assert (v @ v + c * c) / 2 + 0.7 * np.maximum(0, 1 - signs * (x @ v + c)).sum() >= primal - 1e-9


def test_curve_is_a_probability():
    rng = np.random.default_rng(3)
    margins = rng.normal(size=4000)
    signs = np.where(rng.random(4000) < 1 / (1 + np.exp(-(2 * margins - 0.5))), 1, -1)
    slope, offset = quality.logistic(margins, signs, np.ones(4000))
    assert slope == pytest.approx(2, abs=0.2) and offset == pytest.approx(-0.5, abs=0.15)
    assert quality.logistic(np.array([-1.0, 1.0]), np.array([1, -1]), np.ones(2))[0] > 0  # never turned round


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    words = [f"wa{i}le" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        body = [rng.choice(words) for _ in range(rng.randint(8, 90))]
        bad = i % 4 == 0
        if bad:
            body = [w.upper() + "!!" for w in body] if i % 8 else [body[0]] * 40
        rows.append((i, " ".join(body), 7.0))
        labels.append((i, int(not bad), 0))
    rows += [(900, None, 7.0), (901, "", 7.0), (902, "wa1le wa2le " * 60_000, 7.0), (None, "WA!! " * 30, 7.0)] + [(3, f"wa{i}le copy", 7.0) for i in range(300)]
    labels += [(900, None, None), (None, 0, 1), (4, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(tables):
    docs, labels = tables
    scored = quality.train(docs, labels).score(docs)
    assert scored.columns == docs.columns
    rows = scored.withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held and r.doc_id is not None and r.doc_id < 600]
    assert len(judged) > 100 and sum((r.score >= 0.5) == (r.doc_id % 4 != 0) for r in judged) / len(judged) > 0.97
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[900] == by_id[901] and by_id[902] >= 0.5 and by_id[None] < 0.5


def test_sample_is_bounded_and_leaves_out_the_held_out_third(tables):
    docs, labels = tables
    chosen = quality.training_rows(docs, labels, 50).collect()
    assert len(chosen) == 100 and sum(r.label for r in chosen) == 50
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in chosen)
    # an id on very many rows does not enlarge it, and weights restore the share of each class
    every = quality.training_rows(docs, labels, 100_000).collect()
    weights = {r.label: r.weight for r in chosen}
    assert weights == {label: sum(r.label == label for r in every) / 50 for label in (0.0, 1.0)}
    assert all(r.label == 0 for r in every if r.doc_id == 4)  # labelled twice: of quality if all say so


def test_one_class_or_none_to_learn_from(spark, tables):
    docs, labels = tables
    assert {r.score for r in quality.train(docs, labels.filter("quality = 0")).score(docs).collect()} == {0.0}
    assert {r.score for r in quality.train(docs, labels.filter("quality = 1")).score(docs).collect()} == {1.0}
    assert {r.score for r in quality.train(docs, labels.limit(0)).score(docs).collect()} == {0.5}
    assert quality.train(docs.limit(0), labels.limit(0)).score(docs.limit(0)).count() == 0
