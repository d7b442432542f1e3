"""Words of whole batches of messages: postings and pairs of neighbours, sorted and counted as arrays.

The words of a message are cut out by Spark; these helpers work on the Arrow batches inside a task, nothing is
exchanged for them. Work is done in runs of rows with about ``RUN`` words, so memory does not depend on the batch.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

RUN = 1_000_000


def runs(batch: pa.RecordBatch, size: int = RUN) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` words, one row at least."""
    ends = np.cumsum(pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def by_run(work: Callable[..., pa.RecordBatch], **options: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on every run of the batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch):
                yield work(part, **options)

    return run


def _coded(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Codes of all words, the word of each code, the row of each word and the length of each row."""
    words = batch.column("words")
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    row = np.repeat(np.arange(batch.num_rows), lengths)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, row, lengths


def changes(keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))


def postings(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word and row: the word, the row's number, where its places begin and (one more) end; then all places and the rows' lengths."""
    codes, words, row, lengths = _coded(batch)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = codes * batch.num_rows + row
    order = np.argsort(key, kind="stable")
    first = changes(key[order])
    return words.take(pa.array(codes[order][first])), row[order][first], np.append(first, len(codes)), at[order], lengths


def term_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``term, tf, df`` within the batch."""
    codes, words, row, _ = _coded(batch)
    tf = np.bincount(codes, minlength=len(words))
    df = np.bincount(np.unique(codes * max(batch.num_rows, 1) + row) // max(batch.num_rows, 1), minlength=len(words))
    return pa.RecordBatch.from_arrays([words, pa.array(tf, pa.int64()), pa.array(df, pa.int64())], ["term", "tf", "df"])


def pair_counts(batch: pa.RecordBatch, reach: int) -> pa.RecordBatch:
    """``a, b, n`` with ``a < b``: pairs of different words at most ``reach`` places apart within the batch."""
    codes, words, row, _ = _coded(batch)
    order = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    codes, words = rank[codes], words.take(pa.array(order))
    keys = []
    for d in range(1, reach + 1):
        x, y = codes[:-d], codes[d:]
        kept = (row[:-d] == row[d:]) & (x != y)
        x, y = x[kept], y[kept]
        keys.append(np.minimum(x, y) * len(words) + np.maximum(x, y))
    key = np.sort(np.concatenate(keys))
    first = changes(key)
    a, b = np.divmod(key[first], max(len(words), 1))
    n = np.diff(np.append(first, len(key)))
    return pa.RecordBatch.from_arrays([words.take(pa.array(a)), words.take(pa.array(b)), pa.array(n, pa.int64())], ["a", "b", "n"])


def _numbered(batch: pa.RecordBatch, vocabulary: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """The place of every word in the vocabulary, -1 without one, and the row of each word."""
    codes, words, row, _ = _coded(batch)
    place = pc.fill_null(pc.index_in(words, value_set=vocabulary.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return place[codes], row


def known_pairs(batch: pa.RecordBatch, reach: int, vocabulary: Broadcast) -> pa.RecordBatch:
    """``pair, n``: as :func:`pair_counts`, of words of the sorted vocabulary alone; the places of both make one number."""
    codes, row = _numbered(batch, vocabulary)
    size, keys = len(vocabulary.value), []
    for d in range(1, reach + 1):
        x, y = codes[:-d], codes[d:]
        kept = (row[:-d] == row[d:]) & (x != y) & (x >= 0) & (y >= 0)
        x, y = x[kept], y[kept]
        keys.append(np.minimum(x, y) * size + np.maximum(x, y))
    key = np.sort(np.concatenate(keys))
    first = changes(key)
    return pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(np.diff(np.append(first, len(key))), pa.int64())], ["pair", "n"])


def topic_counts(batch: pa.RecordBatch, vocabulary: Broadcast, place: Broadcast, names: Broadcast) -> pa.RecordBatch:
    """The columns beside the words, ``topic, n``: how many words of a row are of a topic; ``place`` is that of a word's topic among the names."""
    codes, row = _numbered(batch, vocabulary)
    kept = codes >= 0
    size = max(len(names.value), 1)
    key = np.sort(row[kept] * size + place.value[codes[kept]])
    first = changes(key)
    row, topic = np.divmod(key[first], size)
    others = [c for c in batch.schema.names if c != "words"]
    columns = [batch.column(c).take(pa.array(row)) for c in others]
    n = np.diff(np.append(first, len(key)))
    return pa.RecordBatch.from_arrays([*columns, names.value.take(pa.array(topic)), pa.array(n, pa.int64())], [*others, "topic", "n"])


def row_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The columns beside the words, ``term, n``: how often a row has a word."""
    terms, row, ends, _, _ = postings(batch)
    names = [c for c in batch.schema.names if c != "words"]
    kept = [batch.column(c).take(pa.array(row)) for c in names]
    return pa.RecordBatch.from_arrays([*kept, terms, pa.array(np.diff(ends), pa.int64())], [*names, "term", "n"])
