"""Exact top-k against all products, nearest neighbours by recall against all cosines."""

import random

import numpy as np
import pytest

from palaver.llm import forest, mips

ODD = [(90_001, None), (90_002, []), (90_003, [1.0, None] * 8), (90_004, [float("nan")] * 16), (90_005, [float("inf")] * 16), (90_006, [0.0] * 16), (90_007, [1.0] * 7)]
COLUMNS = "vec_id bigint, embedding array<double>, lane string, score int"


def brute(rows, queries, k, score):
    out = []
    for q, x in queries:
        found = [(-score(x, y), i) for i, y in rows if i != q and len(x) == len(y)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return out


def spark_rows(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], COLUMNS)


@pytest.mark.parametrize("kind", ["equal", "spread", "clustered"])
def test_top_k_is_exact(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 16))
    if kind == "equal":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "spread":
        x *= rng.pareto(1.5, size=(500, 1))
    else:
        x = x[rng.integers(0, 8, 500)] + rng.normal(size=(500, 16)) * 0.02
    x[100:140] = x[3]
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    monkeypatch.setattr(mips, "LANE", 64)
    monkeypatch.setattr(mips, "BLOCK", 9)
    table = spark_rows(spark, rows + ODD[:5])
    found = sorted(map(tuple, mips.top_k(table, table.filter("vec_id % 10 = 0")).collect()))
    whole = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    assert found == brute(whole, [w for w in whole if w[0] % 10 == 0], 5, dot)


def test_top_k_of_odd_tables(spark):
    table = spark_rows(spark, ODD + [(1, [1.0] * 16), (2, [-1.0] * 16), (2, [-1.0] * 16)])
    found = sorted(map(tuple, mips.top_k(table, table).collect()))
    whole = [(1, [256] * 16), (2, [-256] * 16), (2, [-256] * 16), (90_006, [0] * 16), (90_007, [256] * 7)]
    asked = [whole[0], whole[1], whole[3], whole[4]]
    assert found == sorted(brute(whole, asked, 5, lambda a, b: sum(p * q for p, q in zip(a, b))))
    assert mips.top_k(table.limit(0), table.limit(0)).count() == 0
    assert mips.top_k(table, table.limit(0)).count() == 0


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = forest.nearest(table, table.filter("vec_id % 50 = 0")).collect()
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = wanted = 0
    for q in ids[ids % 50 == 0]:
        scores = x @ x[np.searchsorted(ids, q)]
        scores[np.searchsorted(ids, q)] = -9
        best = set(ids[np.argsort(-scores)[:5]].tolist())
        hits += len(best & {r.vec_id for r in found if r.query_id == q})
        wanted += len(best)
    assert hits / wanted >= 0.9
    assert all(abs(r.score - cosine(rows[r.query_id], rows[r.vec_id])) < 1e-12 for r in found[:200])


def test_small_tables_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(60)]
    rows += [(100 + i, [2 * c for c in rows[i][1]]) for i in range(5)] + [(200, rows[0][1])]
    table = spark_rows(spark, rows + ODD)
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in forest.nearest(table, table.filter("vec_id % 10 = 0")).collect()}
    expected = {(q, n): (i, s) for q, n, i, s in brute(rows, [r for r in rows if r[0] % 10 == 0], 5, cosine)}
    assert found.keys() == expected.keys()
    assert all(found[key][0] == expected[key][0] or abs(found[key][1] - expected[key][1]) < 1e-12 for key in found)
    assert found[0, 1][0] in (100, 200) and abs(found[0, 1][1] - 1) < 1e-12
    assert forest.nearest(table.limit(0), table.limit(0)).count() == 0


@pytest.mark.parametrize("n, least", [(400, 256), (2_000, 0), (3_000, 256), (8_000, 256), (20_000, 256)])
def test_recall_on_random_vectors_of_any_number(monkeypatch, n, least):
    """The lanes of a table as the search meets them; the share compared is counted."""
    x = np.random.default_rng(n).normal(size=(n, 64))
    queries, compared = np.arange(0, n, n // 100), []
    top = forest.V.top
    hits = {q: [] for q in queries.tolist()}
    shared = forest._shared
    monkeypatch.setattr(forest, "_shared", lambda *args: compared.append(args[-1]) or shared(*args))
    for lane in np.array_split(np.random.default_rng(1).permutation(n), -(-n // forest.LANE)):
        lane = np.sort(lane)
        for q, ids, scores in forest._finder(5, forest.TREES, forest.SHARE, least)((lane, None, x[lane]), (queries, None, x[queries])):
            hits[q] += zip((-scores).tolist(), ids.tolist())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = 0
    for q in queries.tolist():
        scores = unit @ unit[q]
        scores[q] = -9
        found += len({i for _, i in sorted(hits[q])[:5]} & set(top(np.arange(n), scores, 5).tolist()))
    assert found / (5 * len(queries)) >= 0.9
    assert sum(compared) <= len(queries) * max(256 * (least > 0), forest.SHARE * n + 2)
