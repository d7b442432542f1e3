"""Near duplicates against exact similarities and components of all pairs."""

import itertools
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from palaver.llm import common, graph, minhash
from palaver.llm.wordhash import Words


def bag(text):
    w = (text or "").split()
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])
    return Counter(runs)


def jaccard(x, y):
    both, either = sum((x & y).values()), sum((x | y).values())
    return both, either


def brute(rows):
    rows = [(d, t) for d, t in rows if d is not None]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [(d, bag(t)) for d, t in rows]
    for (a, x), (b, y) in itertools.combinations(bags, 2):
        both, either = jaccard(x, y)
        if either and both * 5 >= either * 4:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {d: find(d) for d, _ in rows}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [(i, " ".join(text(rng.randint(1, 150)))) for i in range(60)]
    base = text(200)
    for i in range(60):  # a large group of near copies, most of them close to few others only
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(words)))
    line = " ".join(text(12))
    rows += [(300 + i, "\n".join([line] * (10 + i))) for i in range(6)]
    rows += [(400 + i, rows[i][1]) for i in range(10)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "a b"), (504, "a  b"), (505, "b a"), (None, rows[0][1]), (7, rows[7][1])]
    return rows


def test_equals_all_pairs(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, bands string")
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.class_id for r in found if r.doc_id is not None} == brute(rows)
    assert [r.class_id for r in found if r.doc_id is None] == [None]
    kept = minhash.keep_one(docs, spark.createDataFrame(found, "doc_id bigint, class_id bigint"))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(brute(rows).values()))
    assert kept.columns == docs.columns


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_agreement_estimates_similarity():
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    for changed in (5, 15, 40):
        other = list(base)
        for i in rng.sample(range(400), changed):
            other[i] = f"v{i}"
        texts = [" ".join(base), " ".join(other)]
        cells, first = minhash.elements(Words(pa.array(texts)))
        signs = minhash.signatures(cells, first, k=1024)
        both, either = jaccard(*map(bag, texts))
        assert abs((signs[0] == signs[1]).mean() - both / either) < 0.06


def test_signature_ignores_how_texts_are_batched():
    texts = [" ".join(f"w{(i * j) % 97}" for i in range(3 + 5 * j)) for j in range(1, 30)]
    together = minhash.signatures(*minhash.elements(Words(pa.array(texts))))
    alone = np.vstack([minhash.signatures(*minhash.elements(Words(pa.array([t])))) for t in texts])
    assert (together == alone).all()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (101, 102), (7, 7)], "a bigint, b bigint")
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_memory_of_signatures_follows_no_darts():
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(3000)]
    cells, first = minhash.elements(Words(pa.array(texts)))
    tracemalloc.start()
    signs = minhash.signatures(cells, first, minhash.SKETCH)
    peak = tracemalloc.get_traced_memory()[1] - signs.nbytes
    tracemalloc.stop()
    assert peak < 120e6
    few = minhash.signatures(cells[: first[5]], first[:6], minhash.SKETCH)
    assert (few == signs[:5]).all()


def test_bucket_of_texts_alike_but_not_enough(spark):
    """Texts that are 0.6 to 0.77 alike, with a few near copies among them."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(120), 4):
            words[at] = f"v{rng.randrange(100_000)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1] + f" tail{i}") for i in range(0, 40, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = brute(rows)
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, sketched=False).collect()} == wanted


def test_rows_of_one_id(spark):
    rows = [(1, "one text of six words here", "a"), (1, "another text of six other words", "b")] * 3 + [(2, "z", None), (None, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, turn string")
    classes = minhash.near_duplicates(docs)
    kept = [tuple(r) for r in minhash.keep_one(docs, classes).collect()]
    again = [tuple(r) for r in minhash.keep_one(docs.repartition(5), classes).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, again)) and len(kept) == 3


def test_very_long_text(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(120_000))
    docs = spark.createDataFrame([(5, long), (3, long + " end"), (9, long[: len(long) // 2])], "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == {5: 3, 3: 3, 9: 9}


def test_rounds_drop_their_shuffle_files(spark):
    """Without a word to the driver they stay until it collects garbage by itself."""

    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    common.drop_shuffles(spark)
    time.sleep(2)
    before = files()
    edges = spark.range(500).selectExpr("id AS a", "id + 1 AS b")
    graph.components(edges.filter("a % 50 > 0")).count()
    held = files()
    common.drop_shuffles(spark)
    for _ in range(20):
        time.sleep(1)
        if files() - before < (held - before) // 4:
            break
    assert files() - before < (held - before) // 4
