"""Substring dedup by fixed-block anchors.

A word goes if some window of ``window`` consecutive words around it also starts in a
document with a smaller id. Any window holds one whole block of half its length, so:

1. index the non-overlapping blocks of every document and probe them with every rolling run
   of the same length; runs found as a block elsewhere are anchors;
2. extend the anchors: every window around an anchor is hashed whole (80 bits beside its
   part), and the smallest document that holds it is found;
3. cut the union of the windows found in a smaller document, the maximal repeats.

Documents are dealt to chunks by hash. A chunk sends each distinct hash once, packed and
sorted, and gets back which of them repeat: copies within a chunk never travel, a run
that every document has costs one entry per chunk, and nothing is kept per pair of documents.
The chunks are shuffled once and read three times, each time put in order first, since
repeats within a chunk are sent as positions of its words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.llm.common import arrow_schema, give_back, ship
from palaver.llm.wordhash import Words

ship(__name__)

WINDOW = 50
_KEY_BITS = 40
_NO_ID = np.iinfo(np.int64).max

PACKED = "part int, chunk int, kind int, payload binary"
OWN = [
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("kept_sha256", T.StringType()),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("kept_text", T.StringType()),
]
_ANCHORS, _WINDOWS, _LOCAL = 0, 1, 2


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunk_docs: int = 2048, carry: Sequence[str] = (), texts: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, removed, kept_text`` of every document, then ``carry``.

    ``removed`` lists the cut ranges of words; ``kept_text`` is the text without them (the
    text itself if nothing goes; null without ``texts``); the digest is of the kept words
    joined by one space. Windows are judged on the input.

    Null and empty texts have no words; a null text stays null. Rows with a null id neither
    lose words nor make others lose them; rows that share an id are not compared with each
    other. Texts of any length are taken whole. An empty table gives no rows. Columns not in
    ``carry`` are dropped, so they may have any names.
    """
    if window < 3:
        raise ValueError("a window has three words at least")
    rows = docs.count()
    chunks = max(1, math.ceil(rows / chunk_docs))
    bits = min(14, max(3, math.ceil(math.log2(max(1, rows / 4096)))))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")))
    dealt = docs.select(
        F.pmod(key, F.lit(chunks)).cast("int").alias("chunk"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").alias("text"),
        *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)],
    )
    plan = _Plan(window, bits)
    sent = dealt.groupBy("chunk").applyInArrow(lambda own: _lean(plan.index(own)), PACKED)
    anchors = sent.groupBy("part").applyInArrow(lambda sent: _lean(plan.match_anchors(sent)), PACKED)
    windows = dealt.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(lambda own, hits: _lean(plan.extend(own, hits)), PACKED)
    repeats = windows.groupBy("part").applyInArrow(lambda sent: _lean(plan.match_windows(sent)), PACKED)
    fields = [T.StructField(f"carry_{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    cutter = plan.cutter(arrow_schema(T.StructType(OWN)), len(carry), texts)
    cut = dealt.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(lambda own, hits: _lean(cutter(own, hits)), T.StructType(OWN + fields))
    return cut.select(*[f.name for f in OWN], *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)])


def _lean(result: pa.Table) -> pa.Table:
    """A group's result, after what its work left over is given back."""
    give_back()
    return result


def _packed(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("part", "chunk", "kind", "payload"), columns, types)})


def _pack_sorted(values: np.ndarray) -> bytes:
    """Rising numbers as differences of as many bytes as the largest needs."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_sorted(payload: bytes) -> np.ndarray:
    width = payload[0]
    raw = np.frombuffer(payload, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _found(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Index of each value in the rising ``among``, -1 where it is absent."""
    if not len(among):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return np.where(among[at] == values, at, -1)


class _Plan:
    """The task code. ``bits``: two to that power parts take the hashes."""

    def __init__(self, window: int, bits: int):
        self.window, self.block, self.bits = window, (window + 1) // 2, bits

    def _words(self, table: pa.Table) -> tuple[pa.Table, Words, np.ndarray]:
        """The chunk by id and text, its words, and of each document the rank of its id among the chunk's ids (null: none).

        Rows arrive in any order, another one in each pass; rows equal in both have the same words.
        """
        keys = pa.table({"doc_id": table["doc_id"], "text": table["text"].cast(pa.large_string())})
        table = table.take(pc.sort_indices(keys, [("doc_id", "ascending"), ("text", "ascending")]))
        ids = table["doc_id"].fill_null(_NO_ID).to_numpy()
        self.ids, ranks = np.unique(ids, return_inverse=True)
        return table, Words(table["text"]), np.where(ids == _NO_ID, -1, ranks)

    def _anchor_codes(self, words: Words, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a block-long run may start, and its shortened hash; the leading bits are its part."""
        at = np.flatnonzero(words.whole(self.block) & (ranks[words.text_of] >= 0))
        return at, words.runs(self.block, at=at) >> np.uint64(64 - self.bits - _KEY_BITS)

    def index(self, table: pa.Table) -> pa.Table:
        """Every distinct run of a chunk; the last two bits tell of a whole block and of several places."""
        table, words, ranks = self._words(table)
        at, codes = self._anchor_codes(words, ranks)
        if not len(at):
            return _packed([])
        is_block = (at - words.first[words.text_of[at]]) % self.block == 0
        codes = np.sort(codes << np.uint64(1) | is_block.astype(np.uint64))
        heads = np.flatnonzero(np.diff(codes >> np.uint64(1), prepend=np.uint64(2**63)))
        many = np.diff(heads, append=len(codes)) > 1
        block = np.bitwise_or.reduceat(codes & np.uint64(1), heads)
        values = (codes[heads] >> np.uint64(1)) << np.uint64(2) | block << np.uint64(1) | many.astype(np.uint64)
        parts = (values >> np.uint64(_KEY_BITS + 2)).astype(np.int64)
        chunk, mask = table["chunk"][0].as_py(), np.uint64((1 << (_KEY_BITS + 2)) - 1)
        edges = np.flatnonzero(np.diff(parts, prepend=-1))
        return _packed([(int(parts[a]), chunk, _ANCHORS, _pack_sorted(values[a:b] & mask)) for a, b in zip(edges, [*edges[1:], len(parts)])])

    def match_anchors(self, table: pa.Table) -> pa.Table:
        """Runs that are a block somewhere and stand in two places at least, back to the chunks that have them."""
        sent = [_unpack_sorted(p) for p in table["payload"].to_pylist()]
        together = np.sort(np.concatenate(sent))
        heads = np.flatnonzero(np.diff(together >> np.uint64(2), prepend=np.uint64(2**63)))
        flags = np.bitwise_or.reduceat(together & np.uint64(3), heads)
        several = (np.diff(heads, append=len(together)) > 1) | (flags & np.uint64(1) > 0)
        hits = together[heads[several & (flags & np.uint64(2) > 0)]] >> np.uint64(2)
        part, out = table["part"][0].as_py(), []
        for chunk, values in zip(table["chunk"].to_pylist(), sent):
            own = values >> np.uint64(2)
            own = own[_found(own, hits) >= 0]
            if len(own):
                out.append((part, chunk, _ANCHORS, _pack_sorted(own)))
        return _packed(out)

    def extend(self, table: pa.Table, anchors: pa.Table) -> pa.Table:
        """Every distinct window around an anchor with the smallest document of the chunk that holds it."""
        if not table.num_rows or not anchors.num_rows:
            return _packed([])
        table, words, ranks = self._words(table)
        at, codes = self._anchor_codes(words, ranks)
        hits = np.sort(np.concatenate([
            _unpack_sorted(p) | np.uint64(part << _KEY_BITS) for part, p in zip(anchors["part"].to_pylist(), anchors["payload"].to_pylist())
        ]))
        n = len(words.starts)
        found = np.zeros(n + 1, np.int64)
        found[at[_found(codes, hits) >= 0] + 1] = 1
        found = np.cumsum(found)
        reach = np.minimum(np.arange(n) + self.window - self.block + 1, n)
        starts = np.flatnonzero((found[reach] > found[:-1]) & words.whole(self.window) & (ranks[words.text_of] >= 0))
        if not len(starts):
            return _packed([])
        high = words.runs(self.window, 1, starts)
        low = words.runs(self.window, 2, starts) >> np.uint64(48)
        owner = ranks[words.text_of[starts]]
        order = np.lexsort((owner, low, high))
        high, low, owner, starts = high[order], low[order], owner[order], starts[order]
        new = np.ones(len(order), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        heads = np.flatnonzero(new)
        chunk, out = table["chunk"][0].as_py(), []
        # windows that a smaller document of the same chunk has: known here, passed on as they are
        own = np.sort(starts[owner > np.repeat(owner[heads], np.diff(heads, append=len(order)))])
        if len(own):
            out.append((chunk % (1 << self.bits), chunk, _LOCAL, _pack_sorted(own.astype(np.uint64))))
        high, low, owner = high[heads], low[heads], owner[heads]
        parts = (high >> np.uint64(64 - self.bits)).astype(np.int64)
        edges = np.flatnonzero(np.diff(parts, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(parts)]):
            known, place = np.unique(owner[a:b], return_inverse=True)
            head = np.array([b - a, len(known)], "<u4").tobytes()
            body = (high[a:b].tobytes(), low[a:b].astype("<u2").tobytes(), self.ids[known].tobytes(), place.astype("<u4").tobytes() if len(known) > 65535 else place.astype("<u2").tobytes())
            out.append((int(parts[a]), chunk, _WINDOWS, head + b"".join(body)))
        return _packed(out)

    def match_windows(self, table: pa.Table) -> pa.Table:
        """For each chunk, the windows that a smaller document of another chunk has."""
        out, highs, lows, owners, froms, chunks = [], [], [], [], [], []
        for part, chunk, kind, payload in zip(*[table[c].to_pylist() for c in ("part", "chunk", "kind", "payload")]):
            if kind == _LOCAL:
                out.append((part, chunk, kind, payload))
                continue
            n, known = np.frombuffer(payload, "<u4", 2)
            highs.append(np.frombuffer(payload, "<u8", n, 8))
            lows.append(np.frombuffer(payload, "<u2", n, 8 + 8 * n))
            ids = np.frombuffer(payload, "<i8", known, 8 + 10 * n)
            owners.append(ids[np.frombuffer(payload, "<u4" if known > 65535 else "<u2", n, 8 + 10 * n + 8 * known)])
            froms.append(np.full(n, len(chunks)))
            chunks.append((part, chunk))
        if highs:
            high, low, owner, place = map(np.concatenate, (highs, lows, owners, froms))
            order = np.lexsort((owner, low, high))
            high, low, owner, place = high[order], low[order], owner[order], place[order]
            new = np.ones(len(order), bool)
            new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            heads = np.flatnonzero(new)
            lost = np.flatnonzero(owner > np.repeat(owner[heads], np.diff(heads, append=len(order))))
            lost = lost[np.argsort(place[lost], kind="stable")]
            edges = np.flatnonzero(np.diff(place[lost], prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(lost)]):
                rows = lost[a:b]
                part, chunk = chunks[place[rows[0]]]
                out.append((part, chunk, _WINDOWS, np.array([len(rows)], "<u4").tobytes() + high[rows].tobytes() + low[rows].tobytes()))
        return _packed(out)

    def cutter(self, own: pa.Schema, carried: int, texts: bool):
        def cut(table: pa.Table, repeats: pa.Table) -> pa.Table:
            table, words, ranks = self._words(table)
            n = len(words.starts)
            begins = np.zeros(n, bool)
            highs, lows = [np.zeros(0, "<u8")], [np.zeros(0, "<u2")]
            for kind, payload in zip(repeats["kind"].to_pylist(), repeats["payload"].to_pylist()):
                if kind == _LOCAL:
                    begins[_unpack_sorted(payload).astype(np.int64)] = True
                else:
                    count = int(np.frombuffer(payload, "<u4", 1)[0])
                    highs.append(np.frombuffer(payload, "<u8", count, 4))
                    lows.append(np.frombuffer(payload, "<u2", count, 4 + 8 * count))
            high, low = np.concatenate(highs), np.concatenate(lows)
            if len(high):
                at = np.flatnonzero(words.whole(self.window) & (ranks[words.text_of] >= 0))
                order = np.argsort(high, kind="stable")
                high, low = high[order], low[order]
                place = _found(words.runs(self.window, 1, at), high)
                at, place = at[place >= 0], place[place >= 0]
                check = words.runs(self.window, 2, at) >> np.uint64(48)
                same = np.zeros(len(at), bool)
                while len(high):  # equal leading hashes with other trailing ones stand next to each other
                    same |= low[place] == check
                    further = np.minimum(place + 1, len(high) - 1)
                    if not (((further > place) & (high[further] == high[place])) & ~same).any():
                        break
                    place = np.where((further > place) & (high[further] == high[place]), further, place)
                begins[at[same]] = True
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, np.flatnonzero(begins), 1)
            np.add.at(edge, np.flatnonzero(begins) + self.window, -1)
            gone = np.cumsum(edge)[:n] > 0
            gone_before = np.concatenate([[0], np.cumsum(gone)])
            per_doc = gone_before[words.first[1:]] - gone_before[words.first[:-1]]
            digests, spans, kept = [], [], []
            raw = words.bytes
            for i in range(table.num_rows):
                a, b = words.first[i], words.first[i + 1]
                text = raw[words.offsets[i] : words.offsets[i + 1]].tobytes()
                if not per_doc[i]:
                    digests.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                    spans.append([])
                    kept.append(text.decode() if texts else None)
                    continue
                turn = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0))
                ranges = list(zip(turn[::2].tolist(), turn[1::2].tolist()))
                spans.append([{"start": s, "end": e} for s, e in ranges])
                pieces, at_byte = [], 0
                for s, e in ranges:  # from the first word cut to the next word kept
                    pieces.append(text[at_byte : words.starts[a + s] - words.offsets[i]])
                    at_byte = (words.starts[a + e] - words.offsets[i]) if a + e < b else len(text)
                pieces.append(text[at_byte:])
                left = b"".join(pieces)
                digests.append(hashlib.sha256(b" ".join(left.split())).hexdigest())
                kept.append(left.decode() if texts else None)
            if texts and table["text"].null_count:
                kept = [None if null else k for null, k in zip(table["text"].is_null().to_pylist(), kept)]
            columns = [table["doc_id"], np.diff(words.first), per_doc, digests, spans, kept]
            arrays = [c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, own)]
            names = [*own.names, *[f"carry_{i}" for i in range(carried)]]
            return pa.table([*arrays, *[table[f"carry_{i}"] for i in range(carried)]], names=names)

        return cut
