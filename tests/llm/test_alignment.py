"""Token alignment: against all pairs of tokens, corpus-wide counts, odd rows."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers

from palaver.llm import alignment
from palaver.llm.common import table
from palaver.llm.queries import BYTE_MODEL, QUERIES

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(BYTE_MODEL, PIECES)


def overlapping(ends_a, ends_b):
    a, b = [0, *ends_a], [0, *ends_b]
    return [(i, j) for i in range(len(ends_a)) for j in range(len(ends_b)) if max(a[i], b[j]) < min(a[i + 1], b[j + 1])]


def test_equals_all_pairs():
    rng = random.Random(5)
    for _ in range(1500):
        n = rng.randint(1, 60)
        base = [i for i in range(1, n) if rng.random() < 0.7]
        ends_a, ends_b = ([x for x in base if rng.random() < p] + [n] for p in (rng.random(), 0.9))
        groups = alignment.align(ends_a, ends_b)
        closed = [ends_a[i + k] for i, _, m, n_b in groups for k in (range(m) if not n_b else [m - 1])]
        assert closed == sorted(set(ends_a) & set(ends_b))
        assert list(zip(*alignment.links(groups, ends_a, ends_b, range(len(ends_a)), range(len(ends_b))))) == overlapping(ends_a, ends_b)


def test_long_runs_take_few_comparisons():
    class Counted(int):
        compared = 0

        def __eq__(self, other):
            Counted.compared += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    ends = list(range(1, 100_001))
    assert alignment.align(ends, ends) == [(0, 0, 100_000, 0)]
    last = [*ends[:-2], 100_000]  # the end before the last is missing: every block before is compared about once
    assert alignment.align([Counted(x) for x in ends], last) == [(0, 0, 99_998, 0), (99_998, 99_998, 2, 1)]
    assert Counted.compared < 250_000


def test_groups_are_spelled_from_arrays():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(1, 60)
        ends_a, ends_b = (np.array([i for i in range(1, n) if rng.random() < 0.6] + [n]) for _ in range(2))
        ids_a, ids_b = (np.array([rng.choice((0, 9, 10, 4321, 50_000)) for _ in ends]) for ends in (ends_a, ends_b))
        last = alignment.closing(alignment.align(ends_a.tolist(), ends_b.tolist()))
        assert ends_a[last[0]].tolist() == ends_b[last[1]].tolist() == sorted({*ends_a.tolist()} & {*ends_b.tolist()})
        groups, low = [], 0
        for end in ends_a[last[0]]:
            groups.append("|".join(",".join(str(i) for i, at in zip(ids, ends) if low < at <= end) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
            low = end
        assert alignment.spelled(last, ids_a, ids_b, alignment.names(50_001)) == ";".join(groups).encode()


def oracle(rows):
    """Tokens by the two libraries, bytes by their vocabularies, every pair of tokens compared."""
    a = tokenizers.Tokenizer.from_file(BYTE_MODEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    signs = {**{chr(c): c for c in (*range(33, 127), *range(161, 173), *range(174, 256))}}
    signs |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if chr(c) not in signs)}
    spell_a = {i: bytes(signs[c] for c in e) for e, i in a.get_vocab().items() if all(c in signs for c in e)}
    found, linked = {}, {}
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [spell_a.get(i, b"") for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found[doc_id], linked[doc_id] = (0, 0, 0, 0, ""), []
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
        groups, low_a, low_b = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            high_a, high_b = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, ids_a[low_a:high_a])) + "|" + ",".join(map(str, ids_b[low_b:high_b])))
            low_a, low_b = high_a, high_b
        linked[doc_id] = [(ids_a[i], ids_b[j]) for i, j in overlapping(ends_a, ends_b)]
        found[doc_id] = (len(ids_a), len(ids_b), len(groups), len(linked[doc_id]), hashlib.sha256(";".join(groups).encode()).hexdigest())
    counts = Counter(p for own in linked.values() for p in own)
    best = Counter()
    for (_, second), n in counts.items():
        best[second] = max(best[second], n)
    return {d: (*found[d], sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own)) for d, own in linked.items()}


def figures(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in df.collect()}


ODD = [
    (1, "Hello world, hello tokens"), (2, None), (3, ""), (4, "<|endoftext|> and </s> <s> are text"), (5, "▁ is a sign"), (6, "naïve 東京 🙂 ﷽ \u0085 ​"),
    (7, "  two  spaces  "), (8, "tab\tline\n\nend\r\n"), (9, "ﬁ ligature Å Å"), (10, "a\u0000b"), (11, "x" * 3000), (12, "Hello world, hello tokens"), (13, " "),
]


@pytest.mark.parametrize("chunk_bytes", [1, 1 << 23])
def test_odd_texts(spark, pair, chunk_bytes):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id bigint, text string, pairs string").repartition(3)
    assert figures(alignment.aligned(docs, pair, chunk_bytes)) == oracle(ODD)


def test_tables_texts_equal_all_pairs(spark, pair):
    docs = table(spark, FOLDER, "documents").select("doc_id", "text")
    short = docs.filter("doc_id < 60 AND length(text) < 1000")  # the comparison of all pairs grows with the square
    assert figures(alignment.aligned(short, pair)) == oracle([(r.doc_id, r.text) for r in short.collect()])


def test_repeated_rows_and_null_ids_count(spark, pair):
    rows = [(1, "one two"), (1, "one two"), (None, "one two"), (None, None)]
    found = alignment.aligned(spark.createDataFrame(rows, "doc_id bigint, text string"), pair).collect()
    assert sorted((r.doc_id is None, r.n_a, r.count_sum) for r in found) == [(False, 2, 6), (False, 2, 6), (True, 0, 0), (True, 2, 6)]
    assert alignment.aligned(spark.createDataFrame([], "doc_id bigint, text string"), pair).count() == 0


def test_quick_merges_equal_the_file(pair, spark):
    tokens = pair.load()
    assert tokens.fast is not None
    texts = [r.text for r in table(spark, FOLDER, "documents").filter("text IS NOT NULL").collect()]
    texts += ["'s 'LL I'm 3½ x²  \t\n\n a\n b", "".join(map(chr, range(33, 127))), "".join(map(chr, range(161, 592)))]
    for text in texts:
        assert tokens.fast.encode_ordinary(" " + text) == tokens.a.encode(" " + text, add_special_tokens=False).ids


def test_query_has_every_document(spark):
    found = QUERIES["op12_token_alignment"](spark, FOLDER)
    assert found.count() == table(spark, FOLDER, "documents").count()
    assert found.filter("n_links < n_groups OR n_best > n_links OR (n_links > 0 AND count_sum < n_links)").count() == 0
