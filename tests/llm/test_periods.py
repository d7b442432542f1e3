"""Periodic runs: against all stretches, the rule of the query, odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from palaver.llm import periods
from palaver.llm.common import table
from palaver.llm.queries import QUERIES, with_repeats

FOLDER = "/root/testdata/sf0.001"


def next_smaller(s):
    """Longest Lyndon word at each place: up to the next smaller suffix."""
    return [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i for i in range(len(s))]


def all_runs(s, least_length, least_exponent):
    """Every maximal stretch with a period, by trying every period at every place."""
    found = set()
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            begin = i
            while i + q < len(s) and s[i] == s[i + q]:
                i += 1
            length = i - begin + q
            smaller = any(all(s[begin + k] == s[begin + k + d] for k in range(length - d)) for d in range(1, q))
            if length >= max(2 * q, least_length, least_exponent * q) and not smaller:
                found.add((begin, length, q))
            i += 1
    return sorted(found)


def test_groups_give_lyndon_words():
    rng = random.Random(1)
    for _ in range(800):
        s = [rng.randint(0, rng.randint(1, 3)) for _ in range(rng.randint(0, 30))]
        assert periods.lyndon_lengths(s) == next_smaller(s)


@pytest.mark.parametrize("least_length, least_exponent", [(2, 2), (6, 4), (3, 2.5)])
def test_equals_all_stretches(least_length, least_exponent):
    rng = random.Random(least_length)
    for _ in range(120):
        stretches = [[x for _ in range(rng.randint(1, 4)) for x in [rng.randint(0, 2) for _ in range(rng.randint(1, 5))] * rng.randint(1, 6)] for _ in range(rng.randint(1, 4))]
        found = periods.find([np.array(s, np.uint64) for s in stretches], least_length, least_exponent)
        wanted = [(k, *run) for k, s in enumerate(stretches) for run in all_runs(s, least_length, least_exponent)]
        assert list(map(tuple, found.tolist())) == wanted


def test_rows_of_every_kind(spark):
    rows = [
        (1, "a b a b a b a b c", "x"), (2, None, "x"), (3, "", "x"), (4, " \t\n", "x"), (5, "a " * 6, "x"), (5, "a " * 6, "x"),
        (None, "q q q q q q é", "x"), (6, "one " * 5, "x"), (7, " ".join(f"w{i % 5000}" for i in range(20_000)), "x"), (8, "z" * 300_000, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    found = {}
    for r in periods.find_runs(docs).collect():
        found.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert found[1] == [(9, [(0, 8, 2)], "a b c")]
    assert found[2] == found[3] == found[4] == [(0, [], "")]
    assert found[5] == [(6, [(0, 6, 1)], "a")] * 2 and found[None] == [(7, [(0, 6, 1)], "q é")]
    assert found[6] == [(5, [], " ".join(["one"] * 5))]
    assert found[7][0][:2] == (20_000, [(0, 20_000, 5000)]) and found[7][0][2] == " ".join(f"w{i}" for i in range(5000))
    assert found[8] == [(1, [], "z" * 300_000)]
    assert periods.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periods.find_runs(docs, least_exponent=1.5)


def test_runs_across_documents_do_not_join(spark):
    docs = spark.createDataFrame([(i, "a a a") for i in range(8)], "doc_id bigint, text string").coalesce(1)
    assert {len(r.runs) for r in periods.find_runs(docs).collect()} == {0}


def plain(doc_id, text):
    """The rule of the query in plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = _frequent_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        len(runs), *top, 1000 * top[1] // top[2] if runs else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def _frequent_runs(words):
    """As :func:`all_runs` with 6 and 4, one numpy comparison a period."""
    ids = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0, int)
    found, n = [], len(ids)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], (ids[:-q] == ids[q:]).astype(int), [0]])
        turns = np.flatnonzero(np.diff(same))
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
            length = b - a + q
            if length >= max(6, 4 * q) and not any((ids[a : a + length - d] == ids[a + d : a + length]).all() for d in range(1, q)):
                found.append((a, length, q))
    return sorted(found)


def test_query_equals_its_rule(spark):
    docs = table(spark, FOLDER, "documents").select("doc_id", "text").collect()
    found = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in QUERIES["op13_periodic_runs"](spark, FOLDER).collect()}
    assert found == {r.doc_id: plain(r.doc_id, r.text) for r in docs}
    assert sum(v[0] > 0 for v in found.values()) > 5


def test_repeats_of_odd_rows(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    docs = spark.createDataFrame([(ids[0], None), (ids[1], ""), (ids[2], "one"), (None, "a b")], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in with_repeats(docs).collect()} == {ids[0]: None, ids[1]: "", ids[2]: "one", None: "a b"}
