"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text are rates: words of a learned lexicon, words that start like its entries,
disguised entries (digits and signs for letters, letters spaced out), how near they stand
to a second-person word, capitals, punctuation, mixed words. The lexicon, the trees
and the calibration are learned from a bounded sample of the labelled documents that may be learned
from; scoring is Spark ML's ``transform`` over all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import held_out, ship, stored

ship(__name__)

FEATURES = (
    "lexicon", "stems", "disguised", "hits", "spaced", "near_second_person",
    "capitals", "shouted", "punctuation", "exclamations", "mixed", "log_words",
)
STEMS = (4, 5, 6)
# fixed values: second-person words of the languages at hand, and signs used for letters
SECOND_PERSON = frozenset(
    "you your yours yourself youre u ur du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre vos ti usted ustedes tus vosotros os".split()
)
LETTERS_FOR = [str.maketrans({"0": "o", "1": one, "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"}) for one in "il"]
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_SIGNS = re.compile(r"[\W_]+")
_PUNCTUATION = np.isin(np.arange(256), [ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"])
_KNOWN, _STEM, _DISGUISED, _SECOND, _MIXED, _SHOUTED, _SINGLE = 1, 2, 4, 8, 16, 32, 64
_MEMO = 400_000


def entries(text: str | None) -> set[str]:
    """What a text offers to the lexicon: its words, and as ``stem*`` how they start."""
    words = {_EDGES.sub("", w) for w in (text or "").lower().split()}
    words.discard("")
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


class Kinds(dict):
    """What a token is, as bits; worked out once per token and forgotten when there are too many."""

    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self.lexicon = lexicon

    def _in_lexicon(self, word: str) -> int:
        if word in self.lexicon:
            return _KNOWN
        return _STEM if any(len(word) > n and word[:n] + "*" in self.lexicon for n in STEMS) else 0

    def __missing__(self, token: str) -> int:
        word = _EDGES.sub("", token.lower())
        kind = self._in_lexicon(word) if word else 0
        if not kind:
            base = token.lower().strip(".,;:?!\"'()")
            if any(p and p != word and self._in_lexicon(p) == _KNOWN for p in (_SIGNS.sub("", base.translate(t)) for t in LETTERS_FOR)):
                kind = _DISGUISED
        if word in SECOND_PERSON:
            kind |= _SECOND
        if not word.isalpha() and any(map(str.isalpha, word)):
            kind |= _MIXED
        if len(word) > 1 and token.isupper():
            kind |= _SHOUTED
        if len(word) == 1 and word.isalpha():
            kind |= _SINGLE
        if len(self) >= _MEMO:
            self.clear()
        self[token] = kind
        return kind


def features(text: str | None, kinds: Kinds) -> list[float]:
    """The feature values in the order of ``FEATURES``; null and empty texts have zeros."""
    tokens = (text or "").split()
    if not tokens:
        return [0.0] * len(FEATURES)
    found = [kinds[t] for t in tokens]
    counts = Counter(found)
    n = len(tokens)
    of = lambda bit: sum(c for k, c in counts.items() if k & bit)
    known, stems, disguised = of(_KNOWN), of(_STEM), of(_DISGUISED)
    spaced = _spaced(tokens, found, kinds) if of(_SINGLE) >= 3 else 0
    near = 0.0
    if (known or stems or disguised) and of(_SECOND):
        hits = np.array([i for i, k in enumerate(found) if k & (_KNOWN | _STEM | _DISGUISED)])
        second = np.array([i for i, k in enumerate(found) if k & _SECOND])
        at = np.searchsorted(second, hits)
        gap = np.minimum(np.abs(hits - second[np.minimum(at, len(second) - 1)]), np.abs(hits - second[np.maximum(at - 1, 0)]))
        near = float(1.0 / (1.0 + gap.min()))
    by_byte = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    chars = int(by_byte.sum())
    return [
        known / n, stems / n, disguised / n, math.log1p(known + stems + disguised + spaced), spaced / n, near,
        float(by_byte[65:91].sum()) / chars, of(_SHOUTED) / n, float(by_byte[_PUNCTUATION].sum()) / chars,
        float(by_byte[33]) / n, of(_MIXED) / n, math.log1p(n),
    ]


def _spaced(tokens: list[str], found: list[int], kinds: Kinds) -> int:
    """Lexicon words written letter by letter."""
    hits, run = 0, []
    for token, kind in zip([*tokens, ""], [*found, 0]):
        if kind & _SINGLE:
            run.append(_EDGES.sub("", token.lower()))
            continue
        if len(run) >= 3:
            joined = "".join(run)
            hits += any(joined[i:j] in kinds.lexicon for i in range(len(run)) for j in range(i + 3, min(len(run), i + 24) + 1))
        run = []
    return hits


def with_features(docs: DataFrame, lexicon: frozenset[str], text: str = "text") -> DataFrame:
    @F.pandas_udf("array<double>")
    def rates(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kinds = Kinds(lexicon)
        for texts in batches:
            yield pd.Series([features(t, kinds) for t in texts])

    return docs.withColumn("features", array_to_vector(rates(F.col(text))))


def _least(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of smallest hash; of large tables only the smallest hashes, some four times as many, are sorted."""
    share = int(min(1.0, 4 * n / max(1, rows.count())) * (1 << 30))
    return rows.filter(F.shiftrightunsigned("h", 34) < share).orderBy(F.shiftrightunsigned("h", 34), "h").limit(n)


def training_sample(docs: DataFrame, labels: DataFrame, toxic: int = 2500, clean: int = 5000) -> DataFrame:
    """``text, label, fold`` of a bounded sample: at most so many labelled rows of each class, by the hash of their id."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    per_id = known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label")).withColumn("h", F.xxhash64("doc_id"))
    wanted = _least(per_id.filter("label > 0"), toxic).unionByName(_least(per_id.filter("label <= 0"), clean))
    # at most toxic + clean rows of two numbers are broadcast
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(wanted), "doc_id")
        .select("text", F.when(F.col("label") > 0, 1.0).otherwise(0.0).alias("label"), F.pmod("h", F.lit(4)).cast("int").alias("fold"))
    )


def learn_lexicon(sample: DataFrame, size: int = 2000, least: int = 4, odds: float = 3.0) -> frozenset[str]:
    """Entries that ``least`` toxic texts have and whose log-odds against clean texts reach ``odds``, at most ``size``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[float, Counter] = {0.0: Counter(), 1.0: Counter()}
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                seen[label].update(entries(text))
        bad, good = seen[1.0], seen[0.0]
        yield pd.DataFrame([(e, n, good[e]) for e, n in bad.items()] + [(e, 0, n) for e, n in good.items() if e not in bad], columns=["entry", "bad", "good"])

    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = sample.select("text", "label").mapInPandas(count, "entry string, bad bigint, good bigint")
    summed = counted.groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter(F.col("bad") >= least)
    score = F.log((F.col("bad") + 0.5) / F.lit(totals.get(1.0, 0) + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(totals.get(0.0, 0) + 1.0))
    best = summed.withColumn("score", score).filter(F.col("score") >= odds).orderBy(F.desc("score"), F.desc("bad"), "entry").limit(size)
    return frozenset(r.entry for r in best.select("entry").collect())


@dataclass(frozen=True)
class Toxicity:
    """A trained scorer; ``prior`` is the answer where only one class was there to learn from."""

    lexicon: frozenset[str]
    trees: object | None = None
    calibration: object | None = None
    prior: float = 0.0

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``score`` (0 to 1). Null and empty texts are scored like any other."""
        if self.trees is None:
            return docs.withColumn("score", F.lit(self.prior))
        kept = docs.columns
        raw = self.trees.transform(with_features(docs, self.lexicon)).withColumn("raw", vector_to_array("probability")[1])
        scored = self.calibration.transform(raw)
        return scored.select(*kept, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))).alias("score"))


def train(docs: DataFrame, labels: DataFrame, trees: int = 20, depth: int = 3, seed: int = 5) -> Toxicity:
    """Learn from ``labels.toxic`` of the sample: three quarters for lexicon and trees, one for the calibration.

    Null labels and ids are skipped, a document labelled twice is toxic if either says so.
    With rows of one class or none, the scorer is constant.
    """
    sample = stored(training_sample(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), labels), "toxicity-sample")
    found = {r["label"] for r in sample.groupBy("label", "fold").count().collect() if r["fold"] > 0}
    if found != {0.0, 1.0}:
        return Toxicity(frozenset(), prior=float(found == {1.0}))
    lexicon = learn_lexicon(sample.filter("fold > 0"))
    rows = stored(with_features(sample, lexicon).select("features", "label", "fold"), "toxicity-features")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.3).fit(rows.filter("fold > 0").coalesce(4))
    judged = model.transform(rows).select("fold", "label", vector_to_array("probability")[1].alias("raw"))
    own = judged.filter("fold = 0")
    own = judged if own.isEmpty() else own
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(own)
    return Toxicity(lexicon, model, calibration)
