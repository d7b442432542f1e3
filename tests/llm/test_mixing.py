"""Mixing: targets against a loop, conservation, expectations, odd rows."""

import random
from collections import Counter, defaultdict

import pytest

from palaver.llm import mixing

WEIGHTS = (3, 1, 2)


def brute_targets(sizes, budget=1.5, cap=2.0):
    """Share by weight, stop what is above its cap, share the rest among the others, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, free, target = budget * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > cap * sizes[s] + 1e-9]
        if not above:
            return target | {s: left * weight[s] / total for s in free}
        for s in above:
            target[s] = cap * sizes[s]
        free -= set(above)
        left = budget * sum(sizes.values()) - sum(target.values())
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    sources = ["b", "a", "é", "Z", "z1", None, "tiny", "empty"]
    rows = []
    for i in range(1500):
        source = "b" if i % 3 == 0 else rng.choice(sources[:6])
        rows.append((i, " \n".join(["w"] * rng.choice([0, 1, 5, 40, 200])), source, 1))
    rows += [(5000, "one two", "tiny", 1), (5001, None, "empty", 1), (5002, "", "empty", 1), (None, "x y z", "a", 1)]
    rows += [(6000, "same row", "a", 1)] * 40
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")


def test_targets_and_taken(docs):
    rows = mixing.mix(docs, fan_in=16).collect()
    assert len(rows) == docs.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r.size <= 2 * r.size
    expected = brute_targets(sizes)
    assert target.keys() == expected.keys()
    for s in target:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - target[s]) <= 200
    assert {r.doc_id: r.size for r in rows}[5001] == 0
    assert sorted(map(tuple, mixing.mix(docs, fan_in=16).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_every_document_keeps_its_expectation(spark):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    total = defaultdict(int)
    runs = 25
    for seed in range(runs):
        for r in mixing.mix(docs, seed=seed, fan_in=64).collect():
            total[r.source, r.size] += r.copies
            rate = r.target / r.source_size
            assert int(rate) <= r.copies <= int(rate) + 1
    per_group = defaultdict(int)
    for i, text, s in rows:
        per_group[s, 1 + i % 7] += 1
    rates = {r.source: r.target / r.source_size for r in mixing.mix(docs).collect()}
    for (s, size), n in total.items():
        assert n / (runs * per_group[s, size]) == pytest.approx(rates[s], abs=0.2)


def test_repeat_rows(docs):
    mixed = mixing.mix(docs)
    repeated = mixing.repeat_rows(docs, mixed)
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r.copies for r in mixed.collect())


def test_empty_table(docs):
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rows_without_id_keep_to_their_source(spark):
    rows = [(None, f"w{i} " * 10, "a" if i < 400 else "b", i) for i in range(500)] + [(1, "x y", "a", 0)] * 40 + [(2, "z", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, mix_copies int")
    mixed = mixing.mix(docs)
    for group in (1000, 20):
        repeated = mixing.repeat_rows(docs, mixed, group)
        assert repeated.columns == docs.columns
        taken, wanted = Counter(), Counter()
        for r in repeated.collect():
            taken[r.doc_id, r.source] += 1
        for r in mixed.collect():
            wanted[r.doc_id, r.source] += r.copies
        slack = 0 if group > 500 else 25
        assert all(abs(taken[k] - wanted[k]) <= slack for k in taken | wanted)
