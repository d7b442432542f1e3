"""Encoding against the library without dropout, and exact round trips with it."""

import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from palaver.llm import pieces

PATH = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
TEXTS = [
    "Hello world", " leading and  double   spaces ", "line\nbreaks\r\n\ttabs\x0b", "Größe, déjà vu, 日本語のテキスト, 한국어, עברית", "emoji 👩‍👩‍👧 \U0001f600!",
    "<s> and </s> and <unk> and <0x0A>", "a", " ", "\n", "    four", "x" * 300, "aaaaaaa bbbbbb", "1234567890 3.14", " nbsp em",
]


@pytest.fixture(scope="module")
def model():
    return pieces.Model(PATH)


def ids(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def sample_texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def test_without_dropout_equals_the_library(spark, model):
    own, library = pieces.Encoder(model, 0.0, 1, 4), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in [*TEXTS, *sample_texts(spark)[:60]]:
        assert ids(own.encode(text)) == library.encode(text), text[:80]


def test_round_trip_and_variety(spark, model):
    texts = [*TEXTS, "literal ▁ sign▁", "▁", "▁▁ x", *sample_texts(spark)[:40]]
    for rate in (0.0, 0.1, 0.5, 0.95):
        own = pieces.Encoder(model, rate, 3, 4)
        for text in texts:
            assert pieces.decode_ids(ids(own.encode(text)), model.spelled) == text
    plain, dropped, other = (pieces.Encoder(model, r, s, 4) for r, s in ((0.0, 3), (0.2, 3), (0.2, 4)))
    text = " ".join(texts[-40:])
    assert len(dropped.encode(text)) > len(plain.encode(text))
    assert dropped.encode(text) != other.encode(text)
    assert dropped.encode(text) == pieces.Encoder(model, 0.2, 3, 4).encode(text)


def test_share_of_skipped_merges(model):
    for rate in (0.1, 0.4):
        own, rng, skipped = pieces.Encoder(model, rate, 5, 4), random.Random(1), Counter()
        for _ in range(4000):
            first = int(np.searchsorted(own.ladder, np.uint64(rng.randrange(1 << 32)), "right"))
            skipped.update(itertools.takewhile(lambda k: k < 30, own._skips(first, rng.randrange(1 << 32))))
        assert all(abs(skipped[k] / 4000 - rate) < 0.04 for k in range(30))
        assert abs(sum(skipped.values()) / 120_000 - rate) < 0.006


def test_merging_in_step_equals_merging_alone(spark, model):
    rng = random.Random(8)
    words = sorted({w for t in sample_texts(spark)[:30] for w in t.split() if all(map(model.ranks.__contains__, w))})
    words = [w[: rng.randint(1, 40)] for w in rng.sample(words, 400)] + ["a", "aaaaaaa", "abababababab"]
    for rate in (0.0, 0.1, 0.7):
        own = pieces.Encoder(model, rate, 6)
        gaps, rests = np.array([rng.choice([0, 1, 3, 9, len(own.gaps)]) for _ in words]), np.array([rng.randrange(1 << 32) for _ in words], np.uint64)
        found, sizes, taken = own.merge_in_step(*own.symbols(words), *([gaps, rests] if rate else []))
        alone = [own.merge(w, own._skips(int(g), int(r))) for w, g, r in zip(words, gaps, rests)]
        assert [i for packed, _ in alone for i in ids(packed)] == found.tolist()
        assert [len(packed) // 4 for packed, _ in alone] == sizes.tolist() and [n for _, n in alone] == taken.tolist()


def test_texts_together_equal_texts_alone(spark, model):
    own = pieces.Encoder(model, 0.3, 2)
    texts = [*TEXTS, "", None, "literal ▁ sign▁▁", *sample_texts(spark)[:20]]
    rows = [str(i % 3) for i in range(len(texts))]
    together, counts = own.encode_all(texts, rows)
    assert together.tolist() == [i for t, r in zip(texts, rows) for i in ids(pieces.Encoder(model, 0.3, 2).encode(t, r))]
    assert counts.tolist() == [len(own.encode(t, r)) // 4 for t, r in zip(texts, rows)]


def test_table(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "some text", "c"), (3, "some text", "c"), (4, "long " * 100_000, "d"), (None, "▁", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lossless string")
    found = pieces.encode(docs, PATH, check=True)
    assert found.columns == ["doc_id", "text", "pieces", "lossless"]
    back = pieces.decode(found, PATH).collect()
    assert len(back) == 6 and all(r.lossless and r.decoded == r.text for r in back)
    assert {r.doc_id: r.pieces for r in back}[2] == [] and {r.doc_id: r.pieces for r in back}[1] is None
    assert pieces.encode(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(docs, PATH, dropout=1.0)


def test_each_occurrence_has_skips_of_its_own(model):
    own, rng = pieces.Encoder(model, 0.1, 5), random.Random(4)
    for word, least in (("the", 2), ("because", 8), ("international", 12)):
        ids_, counts = own.encode_all([word] * 10_000, list(map(str, range(10_000))))
        each = [tuple(x.tolist()) for x in np.split(ids_, np.cumsum(counts)[:-1])]
        ways = {n: Counter(each[:n]) for n in (100, 10_000)}
        drawn = Counter(tuple(ids(own.merge(pieces.SPACE + word, iter([i for i in range(50) if rng.random() < 0.1]))[0])) for _ in range(10_000))
        assert all(abs(ways[10_000][way] - drawn[way]) < 250 for way in ways[10_000] | drawn)
        assert len(ways[10_000]) > max(least, len(ways[100]) - 1)
        text = " ".join([word] * 2_000)
        assert own.encode(text, "1") != own.encode(text, "2")
        assert len({own.encode(text, str(i)) for i in range(20)}) == 20


def test_memo_changes_no_result(model, monkeypatch):
    rng = random.Random(2)
    words = ["international", "because", "understanding", "a", "x" * 60]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    for rate in (0.1, 0.6):
        own = pieces.Encoder(model, rate, 3)
        found = [own.encode(t) for t in texts]
        assert found == [pieces.Encoder(model, rate, 3).encode(t) for t in texts]
        with monkeypatch.context() as m:
            m.setattr(pieces, "_MEMO", 0)
            assert found == [pieces.Encoder(model, rate, 3).encode(t) for t in texts]


def test_ids_and_copies_vary(spark):
    text = "international understanding because of many words " * 5
    docs = spark.createDataFrame([(i // 2, i % 2, text) for i in range(20)], "doc_id bigint, copy int, text string")
    found = {tuple(r.pieces) for r in pieces.encode(docs, PATH).collect()}
    assert len(found) == 20
    table = docs.drop("copy")
    rows = corpus_pipeline.encode_pieces(spark, table, "").collect()
    assert len({tuple(r.pieces) for r in rows}) == 20 and all(r.lossless for r in rows)
