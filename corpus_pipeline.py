"""The corpus pipeline: name the language, drop near copies, cut repeats, mix sources, encode.

Each stage takes the documents its predecessor kept and returns documents, the last one
encoded documents. Between the stages the documents are written and read again.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import langid, minhash, mixing, pieces, substrings
from palaver.llm.common import spare, stored, table
from palaver.session import configure

PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")

# Every stage but the first depends on hashes or models SQL does not have.
ORACLE_SQL = None

# Rows of an Arrow batch: documents are long, and a batch of the usual 10,000 lies whole in the executor's memory and in the worker's.
BATCH_ROWS = 1000

# Documents of a chunk in which repeats are looked for: its words lie in the worker's memory, beside an executor that earlier stages have filled.
CHUNK_DOCS = 1024


def _configure(spark: SparkSession) -> None:
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is named with a margin; without letters or a clear language they go."""
    _configure(spark)
    return langid.keep_identified(docs, langid.sample_dictionaries(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each class of near duplicates."""
    _configure(spark)
    return minhash.keep_one(docs, minhash.near_duplicates(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a smaller document has; ``n_chars`` follows the text."""
    _configure(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = substrings.remove_repeats(docs, chunk_docs=CHUNK_DOCS, carry=others)
    cut = cut.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("bigint"))
    return cut.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    _configure(spark)
    return mixing.repeat_rows(docs, mixing.mix(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces, and whether these decode to the text."""
    _configure(spark)
    # equal rows are interchangeable; numbered, each copy the mix takes has skips of its own
    n, copy = spare(docs, "_n"), spare(docs, "_copy")
    numbered = docs.groupBy(*docs.columns).agg(F.count(F.lit(1)).alias(n))
    numbered = numbered.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy))
    return pieces.encode(numbered, PIECE_MODEL, check=True, by=["doc_id", copy]).drop(copy)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
