"""Language identification by compression.

Each language has a raw-content dictionary of sample texts; a text belongs to the language
whose dictionary compresses it best. Case, digits and signs are taken off first, and texts
are compressed in blocks, so the dictionary and not the text's own beginning decides
throughout. A text is rejected when the second-best language comes within a margin.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import byte_slices, give_back, held_out, ship

ship(__name__)

UNDETERMINED = "und"
BLOCK = 4096
_SLICE = 1 << 20
LEVEL = 6
# ASCII letters and the bytes of all other characters stay, the rest is a space
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
GUESS = "lang string, score double, margin double"


def sample_dictionaries(docs: DataFrame, texts_per_language: int = 64, text_chars: int = 4000) -> dict[str, bytes]:
    """A dictionary per language, the most frequent first, from a bounded sample of the documents to learn from.

    The bound: ``texts_per_language`` different texts, each of ``text_chars`` characters at
    most (longer texts are cut, and used only where there are not enough others). Which texts
    is decided by their hash. There must be few languages, as there are in the world.
    """
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    texts = usable.groupBy("lang", F.xxhash64("text").alias("h")).agg(
        F.min("doc_id").alias("doc_id"), F.min(F.length("text") > text_chars).alias("is_long")
    )
    # first within lanes of a language, so that what meets in one task does not grow with the number of tasks
    for group in (["lang", F.pmod("h", F.lit(64))], ["lang"]):
        order = F.row_number().over(Window.partitionBy(*group).orderBy("is_long", "h"))
        texts = texts.withColumn("n", order).filter(F.col("n") <= texts_per_language).drop("n")
    chosen = texts.select("doc_id", "h").collect()
    # of an id on very many rows only the texts chosen, each once
    own = F.col("doc_id").isin(sorted({r.doc_id for r in chosen})) & F.xxhash64("text").isin(sorted({r.h for r in chosen}))
    found = (
        docs.filter(own & F.col("lang").isNotNull()).select("lang", F.substring("text", 1, text_chars).alias("text")).distinct().collect()
        if chosen
        else []
    )
    languages: dict[str, list[str]] = {}
    for row in found:
        languages.setdefault(row.lang, []).append(row.text or "")
    rows = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(languages, key=lambda lang: (-rows[lang], lang))
    return {lang: b" ".join(letters(t) for t in sorted(languages[lang])) for lang in order}


def letters(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


@functools.lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    for lang, content in dictionaries:
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=level)
        made.append((lang, zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_dict_id=False)))
    return made


def guess(text: str | None, compressors: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, float]:
    """Language, score and margin of one text."""
    if not text or not compressors or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, 0.0
    raw = letters(text)
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    sizes = [(sum(len(c.compress(b)) for b in blocks), lang) for lang, c in compressors]
    sizes.sort(key=lambda x: x[0])  # stable: the most frequent language wins a tie
    best, lang = sizes[0]
    margin = (sizes[1][0] - best) / sizes[1][0] if len(sizes) > 1 else 1.0
    # each byte saved per compressed hundred counts a factor of e
    rest = sum(math.exp(-100.0 * (s - best) / s) for s, _ in sizes[1:])
    return lang, 1.0 / (1.0 + rest), margin


def classifier(dictionaries: dict[str, bytes], level: int = LEVEL):
    """A vectorised function of a text column; its struct has ``lang, score, margin``."""
    fixed = tuple(dictionaries.items())

    @F.pandas_udf(GUESS)
    def classify(texts: pd.Series) -> pd.DataFrame:
        own = _compressors(fixed, level)
        return pd.DataFrame([guess(t, own) for t in texts], columns=["lang", "score", "margin"])

    return classify


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.002, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with the struct ``into``: ``lang, score, margin, accepted``.

    Only the text decides. A null text or one without a letter is ``und`` with score 0 and not
    accepted, as is every text when nothing was learned; ties go to the more frequent
    language and are not accepted. Texts are taken whole. A column of that name is replaced.
    """
    named = docs.withColumn(into, classifier(dictionaries)(F.col(text)))
    accepted: Column = (F.col(f"{into}.lang") != UNDETERMINED) & (F.col(f"{into}.margin") >= min_margin)
    return named.withColumn(into, F.col(into).withField("accepted", accepted))


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.002, text: str = "text") -> DataFrame:
    """The rows :func:`identify` accepts, with the columns of ``docs``; worked out and left out in the same task, a slice at a time."""
    fixed = tuple(dictionaries.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _compressors(fixed, LEVEL)
        for batch in batches:
            for part in byte_slices(batch, text, _SLICE):
                found = [guess(t, own) for t in part.column(text).to_pylist()]
                yield part.filter(pa.array([lang != UNDETERMINED and margin >= min_margin for lang, _, margin in found]))
        give_back()

    return docs.mapInArrow(run, docs.schema)
