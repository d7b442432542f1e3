"""Alignment of the tokens of two tokenizers by diagonal run skipping.

Both tokenizations of a text are arrays of token ends in bytes. Where an end is in both, a
group closes. Over stretches where the tokens are the same, the ends agree at one
shift between the two indices: one end, then blocks of 4, 8, … ends are compared at that shift, and after the
first block that differs the rest is found by halving, so a stretch costs the logarithm of its length
in comparisons of whole blocks. At an irregular group both indices advance to the next
common end, which gives the new shift. Tokens that share a byte are linked; a group of
``m`` and ``n`` tokens has ``m + n - 1`` links.

How often two ids are linked in all texts is a sum over the corpus. Documents are packed in chunks, a row
each, with a table of the chunk's different id pairs; only these tables are exploded,
summed by pair and sent back to their chunks.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import sys
import types
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.llm.common import arrow_schema, byte_slices, ship, stored

ship(__name__)

SPACE = "▁"
CHUNK_BYTES = 1 << 23
_SLICE = 1 << 20
_PAIR_BITS = 32
# fixed values: the pattern that byte-level pre-tokenization cuts texts with
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Latin letters, ASCII and the signs between: what these characters are does not depend on a Unicode version
_PLAIN = re.compile("[^\t-\r -~¡-ɏ]").search

DOCUMENT = [("doc_id", T.LongType()), ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType())]
CHUNK = T.StructType(
    [
        T.StructField("chunk", T.LongType()),
        T.StructField("documents", T.ArrayType(T.StructType([T.StructField(n, t) for n, t in DOCUMENT]))),
        T.StructField("places", T.BinaryType()),
        T.StructField("pairs", T.ArrayType(T.LongType())),
        T.StructField("times", T.ArrayType(T.LongType())),
    ]
)
RESULT = T.StructType([T.StructField(n, t) for n, t in DOCUMENT] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Two tokenizers read on the driver; what is sent with the tasks are their files, two megabytes together."""

    def __init__(self, byte_path: str, piece_path: str):
        with open(byte_path, encoding="utf-8") as file:
            self.byte_json = file.read()
        with open(piece_path, "rb") as file:
            self.piece_model = file.read()
        self.key = zlib.crc32(self.byte_json.encode()) << 32 | zlib.crc32(self.piece_model)

    def load(self) -> Tokens:
        """The worker's tokenizers, kept from task to task."""
        kept = sys.modules.setdefault("_palaver_alignment", types.ModuleType("_palaver_alignment"))
        if getattr(kept, "key", None) != self.key:
            kept.tokens, kept.key = Tokens(self), self.key
        return kept.tokens


class Tokens:
    def __init__(self, pair: Pair):
        self.a = tokenizers.Tokenizer.from_str(pair.byte_json)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self.fast = self._same_merges(json.loads(pair.byte_json))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pair.piece_model)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode())
        self.sizes_a, self.sizes_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        self.names = names(max(len(self.bytes_a), len(self.bytes_b)))

    def _same_merges(self, file: dict) -> tiktoken.Encoding | None:
        """The same merges as ranks, where the file has nothing beside them: a quicker way for plain texts."""
        model, cut = file["model"], file.get("pre_tokenizer") or {}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model.get("merges", [])]
        plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and file.get("normalizer") is None
        byte_level = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        vocabulary = model["vocab"]
        if not (plain and byte_level and all(vocabulary[m] == 256 + i for i, m in enumerate(merged))):
            return None
        ranks = {self.bytes_a[i]: i for i in range(256 + len(merged))}
        return tiktoken.Encoding("merges", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merged) else None

    def encode(self, texts: Sequence[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of each text by both; empty where the tokens do not spell a space and the text."""
        of_b = self.b.encode(list(texts), num_threads=1)
        for text, b in zip(texts, of_b):
            spaced = " " + text
            raw = spaced.encode()
            if not text or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
                yield [], []
            elif self.fast is not None and _PLAIN(text) is None:  # bytes and merges alone spell every text
                yield self.fast.encode_ordinary(spaced), b
            else:
                a = self.a.encode(spaced, add_special_tokens=False).ids
                yield (a, b) if b"".join(map(self.bytes_a.__getitem__, a)) == raw else ([], [])


def align(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups of two tokenizations of the same bytes as ``i, j, m, n``: ``m`` tokens from ``i`` on and ``n`` from ``j`` on.

    A stretch of ``k`` groups of one token each is one row ``i, j, k, 0``.
    """
    out, i, j, n = [], 0, 0, len(ends_a)
    ends_a, ends_b = [*ends_a, -1], [*ends_b, -2]  # a run ends with the arrays
    while i < n:
        end_a, end_b = ends_a[i], ends_b[j]
        if end_a == end_b:
            a, b = i + 1, j + 1
            for _ in range(3):
                if ends_a[a] != ends_b[b]:
                    break
                a += 1
                b += 1
            else:
                step = 4
                while ends_a[a : a + step] == ends_b[b : b + step]:  # doubled while the blocks agree
                    a += step
                    b += step
                    step *= 2
                while step > 1:  # halved after the block that differs
                    step //= 2
                    if ends_a[a : a + step] == ends_b[b : b + step]:
                        a += step
                        b += step
            out.append((i, j, a - i, 0))
            i, j = a, b
        else:
            a, b = i, j
            while end_a != end_b:
                if end_a < end_b:
                    a += 1
                    end_a = ends_a[a]
                else:
                    b += 1
                    end_b = ends_b[b]
            out.append((i, j, a - i + 1, b - j + 1))
            i, j = a + 1, b + 1
    return out


def closing(groups: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The last token of every group in both tokenizations."""
    i, j, m, n = np.fromiter(itertools.chain.from_iterable(groups), np.int64, 4 * len(groups)).reshape(-1, 4).T
    size = np.where(n > 0, 1, m)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(np.where(n > 0, i + m - 1, i), size) + step, np.repeat(np.where(n > 0, j + n - 1, j), size) + step


def links(groups: list[tuple[int, int, int, int]], ends_a: Sequence, ends_b: Sequence, a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """The members of ``a`` and ``b`` (one for each token) that are linked: pairs along the runs, stairs within the other groups."""
    return _linked(closing(groups), np.asarray(ends_a), np.asarray(ends_b), np.asarray(a), np.asarray(b))


def _linked(last: tuple[np.ndarray, np.ndarray], ends_a: np.ndarray, ends_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every end within a group is a step of its stairs, and the common end closes it: a link for each end."""
    last_a, last_b = last
    inner = np.ones(len(b), bool)
    inner[last_b] = False
    order = np.argsort(np.concatenate([ends_a, ends_b[inner]]), kind="stable")  # two rising runs
    of_a = order < len(a)
    moves_b = ~of_a
    moves_b[np.flatnonzero(of_a)[last_a]] = True
    return a[np.cumsum(of_a) - of_a], b[np.cumsum(moves_b) - moves_b]


def names(n: int) -> np.ndarray:
    """The numbers below ``n`` as rows of zero bytes, decimal digits and a comma."""
    width = len(str(n))
    return np.array([str(i).rjust(width, "\0") + "," for i in range(n)], f"S{width + 1}").view(np.uint8).reshape(n, -1)


def spelled(last: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, names: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group, whose last tokens are given."""
    last_a, last_b = last
    rows = np.empty((len(a) + len(b), names.shape[1]), np.uint8)
    # a token stands behind all of its own tokenization before it and those of the other up to its group
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    at_a = np.arange(len(a)) + np.repeat(last_b + 1 - size_b, size_a)
    at_b = np.arange(len(b)) + np.repeat(last_a + 1, size_b)
    for ids, at, ends, sign in ((a, at_a, last_a, b"|"), (b, at_b, last_b, b";")):
        rows[at] = names[ids]
        rows[at[ends], -1] = ord(sign)
    return rows[rows > 0].tobytes()[:-1]


class _Chunk:
    """Collects documents until there are enough bytes, then packs them as one row."""

    def __init__(self, number: int):
        self.number, self.documents, self.size = number, [], 0
        self.codes: list[np.ndarray] = []  # of each document the different pairs
        self.often: list[np.ndarray] = []  # and how often it has each

    def add(self, doc_id: int | None, a: list[int], b: list[int], tokens: Tokens) -> None:
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(tokens.sizes_a[ids_a]), np.cumsum(tokens.sizes_b[ids_b])
        groups = align(ends_a.tolist(), ends_b.tolist())
        last = closing(groups)
        left, right = _linked(last, ends_a, ends_b, ids_a, ids_b)
        codes = np.sort(left << _PAIR_BITS | right)
        heads = np.flatnonzero(np.diff(codes, prepend=-1))
        self.codes.append(codes[heads])
        self.often.append(np.diff(heads, append=len(codes)))
        digest = hashlib.sha256(spelled(last, ids_a, ids_b, tokens.names)).hexdigest() if groups else ""
        self.documents.append((doc_id, len(a), len(b), len(last[0]), len(left), digest))
        self.size += 64 + (int(ends_a[-1]) if len(ends_a) else 0)

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        often = np.concatenate(self.often)
        pairs, which = np.unique(np.concatenate(self.codes), return_inverse=True)
        times = np.bincount(which, often, len(pairs)).astype(np.int64)
        # of each document the places in the table of pairs, rising
        cells = np.repeat(np.arange(len(self.codes)), [len(c) for c in self.codes]) * max(1, len(pairs)) + which
        head = np.array([len(cells)], "<i8").tobytes()
        packed = zstandard.compress(head + np.diff(cells, prepend=0).astype("<i8").tobytes() + often.astype("<u4").tobytes(), 3)
        names = [n for n, _ in DOCUMENT]
        documents = [dict(zip(names, d)) for d in self.documents]
        columns = [[self.number], [documents], [packed], pa.array([pairs]), pa.array([times])]
        arrays = [pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


def chunks(docs: DataFrame, pair: Pair, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Documents in chunks of about so many bytes: their figures, and what they need of the corpus-wide counts."""
    schema = arrow_schema(CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pair.load()
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number)
        for batch in batches:
            for part in byte_slices(batch, "text", _SLICE):
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, (a, b) in zip(part.column("doc_id").to_pylist(), tokens.encode(texts)):
                    chunk.add(doc_id, a, b, tokens)
                    if chunk.size >= chunk_bytes:
                        yield chunk.row(schema)
                        number += 1
                        chunk = _Chunk(number)
        if chunk.documents:
            yield chunk.row(schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CHUNK)


def pair_counts(packed: DataFrame) -> DataFrame:
    """``pair, total, best``: how many links of all chunks hold the ids, and whether no pair of the same second id has more."""
    entries = packed.select(F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("e.pairs", "e.times")
    totals = entries.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("total"))
    second = F.col("pair").bitwiseAND(F.lit((1 << _PAIR_BITS) - 1))
    most = totals.groupBy(second.alias("second")).agg(F.max("total").alias("most"))
    return totals.join(most, second == F.col("second")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, pair: Pair, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` of every document.

    A space and the text is encoded by both tokenizers. ``n_groups`` counts the pieces between bytes where a token of
    both ends, ``n_links`` the pairs of tokens that share a byte; ``n_best`` are the links whose id pair is the
    most frequent one of its second id in all documents, ties included, and ``count_sum`` adds up the frequencies of all
    links. ``groups_sha256`` is the digest of :func:`spelled`. Texts that are null, empty or not spelled by their
    tokens have zeros and an empty digest. Rows are taken one by one, whatever their ids, and all count.
    """
    packed = stored(chunks(docs, pair, chunk_bytes), "alignment-chunks")
    counts = stored(pair_counts(packed), "alignment-pairs")
    wanted = packed.select("chunk", F.posexplode("pairs").alias("pos", "pair"))
    # a chunk's table is bounded by the chunk's bytes
    sent = wanted.join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("pos", "total", "best")).alias("counts"))
    schema = arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                documents = batch.column("documents")[k].values
                figures = [documents.field(n) for n, _ in DOCUMENT]
                n = len(documents)
                sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
                if (counts := batch.column("counts")[k]).is_valid:
                    pos, total, best = (np.asarray(counts.values.field(f)) for f in ("pos", "total", "best"))
                    order = np.argsort(pos)
                    raw = zstandard.decompress(batch.column("places")[k].as_py())
                    size = int(np.frombuffer(raw, "<i8", 1)[0])
                    cells = np.cumsum(np.frombuffer(raw, "<i8", size, 8))
                    often = np.frombuffer(raw, "<u4", size, 8 + 8 * size).astype(np.int64)
                    owner, place = cells // len(pos), order[cells % len(pos)]
                    for out, value in zip(sums, (best[place] * often, total[place] * often)):
                        np.add.at(out, owner, value)
                yield pa.RecordBatch.from_arrays([*[f.cast(s.type) for f, s in zip(figures, schema)], *map(pa.array, sums)], schema=schema)

    return packed.select("chunk", "documents", "places").join(sent, "chunk", "left").mapInArrow(run, RESULT)
