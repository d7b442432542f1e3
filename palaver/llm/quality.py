"""Quality by naive Bayes support vectors.

A text is the set of its n-grams: words, pairs of words, runs of three bytes, and a word said
two, three, four and eight times on end (whatever the word), hashed to ``BUCKETS``. An indicator of an n-gram is scaled by the log
of how much more often texts of one class have it than those of the other, the scaled
vector has length 1, and a linear model with hinge loss is fitted to such vectors by dual
coordinate descent. Margins become probabilities by a logistic curve fitted on texts the model has not seen.

The model is learned from a bounded sample of the labelled documents that may be learned from;
every text is scored whole, in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.llm.common import arrow_schema, byte_slices, ship, stored
from palaver.llm.wordhash import Words, mixed

ship(__name__)

BITS = 18
BUCKETS = 1 << BITS
REPEATS = (2, 3, 4, 8)
_SLICE = 1 << 20
_SALT = np.uint64(0x9E3779B97F4A7C15)
MODEL = "scaled binary, square binary, bias double, slope double, offset double"


def held_out(doc_id: Column) -> Column:
    """The third of the documents no model may learn from; rows without an id are never learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of every text, rising, and where each text's begin (and the total)."""
    words = Words(texts)
    n = len(words.starts)
    pairs = np.flatnonzero(words.whole(2))
    second = words.hashes[np.minimum(pairs + 1, max(0, n - 1))]
    of_pairs = mixed(words.hashes[pairs] * np.uint64(3) + second)
    again = np.zeros(n + 1, np.int64)  # at each word, how many of the words before it equal the next one
    again[pairs + 1] = words.hashes[pairs] == second
    sums = np.cumsum(again)
    ends = [np.flatnonzero(sums[k - 1 : n] - sums[: n - k + 1] == k - 1) + k - 1 for k in REPEATS if k <= n]
    of_repeats = mixed(np.repeat(np.array(REPEATS[: len(ends)], np.uint64), [len(e) for e in ends]))
    ends = np.concatenate([*ends, np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
    raw = words.bytes.astype(np.uint64)
    inside = np.flatnonzero(owner[2:] == owner[:-2]) if len(raw) > 2 else np.zeros(0, np.int64)
    of_bytes = mixed((raw[inside] << np.uint64(16) | raw[inside + 1] << np.uint64(8) | raw[inside + 2]) + _SALT)
    hashes = np.concatenate([mixed(words.hashes + np.uint64(7)), of_pairs, of_bytes, of_repeats])
    owners = np.concatenate([words.text_of, words.text_of[pairs], owner[inside], words.text_of[ends]])
    keys = np.sort(owners.astype(np.int64) << BITS | (hashes >> np.uint64(64 - BITS)).astype(np.int64))
    keys = keys[np.diff(keys, prepend=-1) > 0]
    return (keys & (BUCKETS - 1)).astype(np.int32), np.searchsorted(keys, np.arange(len(words.offsets), dtype=np.int64) << BITS)


def log_ratios(rows: list[np.ndarray], signs: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Log of each n-gram's share in the texts of one class against the other."""
    shares = []
    for sign in (1, -1):
        own = [r for r, s in zip(rows, signs) if s == sign]
        counts = smoothing + np.bincount(np.concatenate(own), minlength=BUCKETS)
        shares.append(counts / counts.sum())
    return np.log(shares[0] / shares[1])


def dual_coordinate_descent(
    rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, width: int, cost: float = 1.0, epochs: int = 60, tolerance: float = 1e-3, seed: int = 3
) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of ``min w²/2 + b²/2 + cost * sum(max(0, 1 - y (w x + b)))``.

    One dual variable at a time is set to its best value between 0 and ``cost``, in an order drawn anew
    in each epoch, until no gradient of an epoch exceeds the tolerance.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    weights, bias, alpha = np.zeros(width), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            at, values = rows[i]
            y = signs[i]
            gradient = y * (float(weights[at] @ values) + bias) - 1.0
            projected = min(gradient, 0.0) if alpha[i] <= 0 else max(gradient, 0.0) if alpha[i] >= cost else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
                step = (new - alpha[i]) * y
                weights[at] += step * values
                bias += step
                alpha[i] = new
        if worst <= tolerance:
            break
    return weights, bias, alpha


def logistic(margins: np.ndarray, signs: np.ndarray, weights: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of the curve from margins to probabilities, by Newton steps on smoothed targets."""
    positive, negative = weights[signs > 0].sum(), weights[signs < 0].sum()
    target = np.where(signs > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    slope, offset = 1.0, float(np.log((positive + 1) / (negative + 1)))

    def loss(a: float, b: float) -> float:
        z = a * margins + b
        return float((weights * (np.logaddexp(0, z) - target * z)).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -700, 700)))
        error, curve = weights * (p - target), weights * p * (1 - p)
        gradient = np.array([error @ margins, error.sum()])
        if np.abs(gradient).max() < 1e-7 * weights.sum():
            break
        hessian = np.array([[curve @ margins**2, curve @ margins], [curve @ margins, curve.sum()]]) + 1e-9 * np.eye(2)
        step, size, before = np.linalg.solve(hessian, gradient), 1.0, loss(slope, offset)
        while size > 1e-6 and loss(slope - size * step[0], offset - size * step[1]) > before:
            size /= 2
        slope, offset = slope - size * step[0], offset - size * step[1]
    return max(slope, 1e-3), offset


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """``doc_id, text_hash, label, h``: at most ``per_class`` texts of each class, by hash; a repeated text of an id once.

    An id labelled twice is of quality if all its labels say so. Only ids and hashes are exchanged.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").filter("quality IS NOT NULL AND doc_id IS NOT NULL")
    per_id = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.min("quality") > 0).cast("double").alias("label"))
    texts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    usable = stored(texts.join(per_id, "doc_id").distinct().withColumn("h", F.xxhash64("doc_id", "text_hash")), "quality-labelled")
    found = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = []
    for label, n in sorted(found.items()):
        # only the smallest hashes, some four times as many as are wanted, are put in order
        share = int(min(1.0, 4 * per_class / n) * (1 << 30))
        own = usable.filter((F.col("label") == label) & (F.shiftrightunsigned("h", 34) < share))
        part = own.orderBy(F.shiftrightunsigned("h", 34), "h", "doc_id").limit(per_class)
        parts.append(part.withColumn("weight", F.lit(n / min(n, per_class))))
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else usable.withColumn("weight", F.lit(1.0))


@dataclass(frozen=True)
class Quality:
    """A trained scorer; without a model ``prior`` is the answer for every text."""

    scaled: np.ndarray | None = None
    square: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    prior: float = 0.5

    def margins(self, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Signed distances of texts; one without n-grams has the bias alone."""
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        dot = np.bincount(owner, self.scaled[grams], len(first) - 1)
        norm = np.sqrt(np.bincount(owner, self.square[grams], len(first) - 1))
        return dot / np.where(norm > 0, norm, 1.0) + self.bias

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``score`` (0 to 1). Null and empty texts have the score of a text without n-grams; a column of that name is replaced."""
        kept = [c for c in docs.columns if c != "score"]
        if self.scaled is None:
            return docs.select(*kept, F.lit(self.prior).alias("score"))
        schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])
        arrow = arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in byte_slices(batch, text, _SLICE):
                    margins = self.margins(*ngrams(part.column(text)))
                    scores = 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -700, 700)))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], schema=arrow)

        return docs.select(*kept).mapInArrow(run, schema)


def fit(rows: list[np.ndarray], signs: np.ndarray, folds: np.ndarray, weights: np.ndarray, cost: float) -> Quality:
    """The model of the folds above 0, its curve from fold 0 (or all, where fold 0 has one class only)."""
    learned = np.flatnonzero(folds > 0)
    ratios = log_ratios([rows[i] for i in learned], signs[learned])
    vectors = []
    for i in learned:
        values = ratios[rows[i]]
        norm = float(np.sqrt(values @ values))
        vectors.append((rows[i], values / norm if norm else values))
    fitted, bias, _ = dual_coordinate_descent(vectors, signs[learned], BUCKETS, cost)
    model = Quality((fitted * ratios).astype(np.float32), (ratios * ratios).astype(np.float32), bias)
    judged = np.flatnonzero(folds == 0)
    if len(set(signs[judged].tolist())) < 2:
        judged = np.arange(len(rows))
    first = np.concatenate([[0], np.cumsum([len(rows[i]) for i in judged])])
    margins = model.margins(np.concatenate([rows[i] for i in judged]), first)
    slope, offset = logistic(margins, signs[judged], weights[judged])
    return Quality(model.scaled, model.square, bias, slope, offset)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, cost: float = 16.0) -> Quality:
    """Learn from ``labels.quality``: three quarters of the sample for the model, one for the curve.

    The bound: ``per_class`` texts of each class, taken by the hash of id and text; one task fits the model to their n-grams, at most
    ``BUCKETS`` a text. Null labels and ids are skipped. Where one class is missing, the
    scorer is constant: the class that is there, or one half where there is none.
    """
    wanted = stored(training_rows(docs, labels, per_class), "quality-sample")
    counted = {(r["label"], r["learned"]): r["n"] for r in wanted.groupBy("label", (F.pmod("h", F.lit(4)) > 0).alias("learned")).agg(F.count(F.lit(1)).alias("n")).collect()}
    found = {label for label, learned in counted if learned}
    if len(found) < 2:
        return Quality(prior=found.pop() if found else 0.5)
    # twice per_class rows of a few numbers are broadcast
    sample = (
        docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
        .join(F.broadcast(wanted), ["doc_id", "text_hash"])
        .dropDuplicates(["doc_id", "text_hash"])
        .select("h", "label", F.pmod("h", F.lit(4)).cast("int").alias("fold"), "weight", F.col("text").cast("string").alias("text"))
    )
    read = T.StructType([*[sample.schema[c] for c in ("h", "label", "fold", "weight")], T.StructField("grams", T.ArrayType(T.IntegerType()))])
    grams_schema = arrow_schema(read)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", _SLICE):
                grams, first = ngrams(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(grams))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], lists.cast(grams_schema.field("grams").type)], schema=grams_schema)

    rows = stored(sample.mapInArrow(cut, read), "quality-grams")
    model_schema = arrow_schema(T.StructType.fromDDL(MODEL))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        table = table.sort_by("h")
        sets = [np.asarray(x.values) for x in table["grams"]]
        signs = np.where(np.asarray(table["label"]) > 0, 1, -1)
        made = fit(sets, signs, np.asarray(table["fold"]), np.asarray(table["weight"]), cost)
        values = [made.scaled.tobytes(), made.square.tobytes(), float(made.bias), float(made.slope), float(made.offset)]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, model_schema)], schema=model_schema)

    made = rows.repartition(1).mapInArrow(learn, MODEL).first()
    return Quality(np.frombuffer(made.scaled, np.float32), np.frombuffer(made.square, np.float32), made.bias, made.slope, made.offset)
