"""Substring dedup against a brute-force reading of its rule."""

import hashlib
import random
import re

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from palaver.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (doc, _), w in zip(rows, words):
        if doc is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                least[key] = min(least.get(key, doc), doc)
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        if doc is not None:
            for i in range(len(w) - window + 1):
                if least[tuple(w[i : i + window])] < doc:
                    gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=90, window=50):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ß x", "日本"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(window - 2, window + 30))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 180))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            passage = rng.choice(passages)
            cut = rng.randint(0, 12)
            words[at:at] = passage[cut:]
        rows.append((i * 3, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(1000 + i, rows[i][1]) for i in range(8)]
    rows += [(5, "x " * 400), (7, "x " * 300 + "y " * 60), (9, " ".join(f"w{i % 7}" for i in range(500)))]
    rows += [(None, rows[3][1]), (2000, None), (2001, ""), (2002, " \n\x0b "), (2003, "a b c"), (6, rows[2][1]), (6, rows[2][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window, chunk_docs", [(50, 2048), (50, 10), (7, 16)])
def test_equals_brute_force(spark, window, chunk_docs):
    rows = corpus(window + chunk_docs, window=window)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = substrings.remove_repeats(docs, window=window, chunk_docs=chunk_docs).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found], key=str) == brute(rows, window)
    for r in found:
        if r.kept_text is not None:
            assert hashlib.sha256(" ".join(WORD.findall(r.kept_text)).encode()).hexdigest() == r.kept_sha256
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_carried_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 3), (2, None, None, 4)], "doc_id bigint, text string, chunk string, payload int")
    found = substrings.remove_repeats(docs, carry=["chunk", "payload"]).orderBy("doc_id").collect()
    assert [(r.doc_id, r.kept_text, r.chunk, r.payload) for r in found] == [(1, "a b", "x", 3), (2, None, None, 4)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert substrings.remove_repeats(docs).count() == 0


def test_long_text(spark):
    long = " ".join(f"v{i}" for i in range(200_000)) + " " + "z" * 3_000_000
    docs = spark.createDataFrame([(1, long), (2, "start " + long)], "doc_id bigint, text string")
    found = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(docs, texts=False).collect()}
    assert found == {1: (200_001, 0), 2: (200_002, 200_001)}


def grouped(table, key):
    return [table.filter(pa.compute.equal(table[key], k)) for k in sorted(set(table[key].to_pylist()))]


@pytest.mark.parametrize("seed", range(4))
def test_row_order_differs_between_passes(seed):
    rows, rng = corpus(seed, window=7), random.Random(seed)
    plan = substrings._Plan(7, 3)

    def chunk():
        rng.shuffle(rows)
        return pa.table({"chunk": pa.array([0] * len(rows), pa.int32()), "doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})

    anchors = pa.concat_tables([plan.match_anchors(t) for t in grouped(plan.index(chunk()), "part")])
    repeats = pa.concat_tables([plan.match_windows(t) for t in grouped(plan.extend(chunk(), anchors), "part")])
    cut = plan.cutter(substrings.arrow_schema(substrings.T.StructType(substrings.OWN)), 0, True)(chunk(), repeats).to_pylist()
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in cut], key=str) == brute(rows, 7)
