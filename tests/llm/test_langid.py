"""Language identification: held-out accuracy and odd texts."""

import random

import pytest

from palaver.llm import langid
from palaver.llm.common import held_out
from pyspark.sql import functions as F

SYLLABLES = {"xa": "ka ro mi tu sel", "xb": "bor gun feth wic ond", "xc": "éla çou nière tiq ou"}


def text(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    langs = list(SYLLABLES)
    rows = [(i, text(rng, lang := langs[i % 3], rng.randint(8, 300)), lang, "x") for i in range(300)]
    rows += [(1000 + i, rows[0][1], "xa", "y") for i in range(200)]
    rows += [(2000, None, "xa", None), (2001, "", "xb", None), (2002, "12 !? 34", "xc", None), (None, rows[1][1], None, None)]
    rows += [(2003, text(rng, "xb", 30_000), None, None), (2004, rows[2][1].upper() + "!!! 77", "xa", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, language string")


def test_held_out_accuracy_and_odd_texts(docs):
    found = langid.identify(docs, langid.sample_dictionaries(docs)).select("doc_id", "lang", "language.*", held_out(F.col("doc_id")).alias("held")).collect()
    assert len(found) == docs.count()
    judged = [r.asDict() for r in found if r.held and r.doc_id is not None and r.doc_id < 1000]
    named = [r[2] for r in docs.select("doc_id", "language", "lang").collect() if r.doc_id is not None and r.doc_id < 1000]
    assert len(judged) > 30 and set(named) == set(SYLLABLES)
    by_id = {r.doc_id: r for r in found}
    langs = list(SYLLABLES)
    assert sum(r["lang"] == langs[r["doc_id"] % 3] for r in judged) / len(judged) > 0.97
    for odd in (2000, 2001, 2002):
        assert by_id[odd][2:5] == ("und", 0.0, 0.0) and not by_id[odd].accepted
    assert by_id[2003][2] == "xb" and by_id[2004][2] == "xc" and by_id[None][2] == "xb"
    assert all(0 <= r.score <= 1 for r in found)


def test_sample_is_bounded_and_skips_what_is_held_out(docs):
    learned = langid.sample_dictionaries(docs, texts_per_language=3, text_chars=50)
    assert set(learned) == set(SYLLABLES) and all(len(v) <= 3 * 51 * 2 for v in learned.values())
    only_held = docs.filter(held_out(F.col("doc_id")))
    assert langid.sample_dictionaries(only_held) == {}


def test_nothing_learned_and_empty_table(spark, docs):
    found = langid.identify(docs.limit(5), {}).select("language.*").collect()
    assert {(r.lang, r.score, r.accepted) for r in found} == {("und", 0.0, False)}
    assert langid.identify(docs.limit(0), {"a": b"abc"}).count() == 0
    assert langid.sample_dictionaries(docs.limit(0)) == {}


def test_ties_are_rejected(spark):
    rows = spark.createDataFrame([(1, "zzz")], "doc_id bigint, text string")
    found = langid.identify(rows, {"b": b"abc", "a": b"abc"}).select("language.*").first()
    assert (found.lang, found.margin, found.accepted) == ("b", 0.0, False)
