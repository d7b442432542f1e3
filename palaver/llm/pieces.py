"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text is cut where no piece can cross, and each part is merged bottom up from an agenda,
best merge first, as the model's merge order says. With dropout, each candidate taken from the
agenda is skipped at the rate, drawn by a hash keyed by seed, document and the part's place in
the text; it can come back only when a neighbour changes. Each seed gives another segmentation,
each one decodes to the same text. Without dropout the result is the model's own.

A hash draws how many candidates pass before one is skipped. Where that is more than the part
has, it is merged as without dropout, which is remembered and changes no result. The other parts of a slice
of texts are merged in step: a row of symbols for each part, all rows taking their best candidate at once.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import heapq
import itertools
import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palaver.llm.common import arrow_schema, byte_slices, give_back, ship, taken_names

ship(__name__)

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
KEYS = 4
_MEMO, _SHORT = 250_000, 40
_WIDTHS = (6, 10, 16, _SHORT)
_SLICE = 1 << 20
_NONE = np.int64((1 << 62) - 1)
_MASK = (1 << 32) - 1
_LONGEST_GAP = 4096


class Model:
    """A merge model's pieces; built on the driver from a file and sent with the tasks (32,000 pieces are under a megabyte)."""

    def __init__(self, path: str):
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ranks: dict[str, tuple[float, int]] = {}
        self.bytes: list[int] = [0] * 256
        self.spelled: list[bytes] = []
        for i in range(own.get_piece_size()):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.spelled.append(bytes([int(piece[3:5], 16)]))
            elif own.is_control(i) or own.is_unknown(i):
                self.spelled.append(b"")
            else:
                self.ranks[piece] = (-own.get_score(i), i)
                self.spelled.append(piece.replace(SPACE, " ").encode())
        # a part is a run of spaces and what follows; line ends and tabs are parts where no piece has them
        if any(SPACE in p.lstrip(SPACE) for p in self.ranks):
            raise ValueError("a piece of this model goes on after a word's end")
        alone = "".join(c for c in "\n\t" if not any(c in p for p in self.ranks))
        self.parts = f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+"


class Pairs:
    """Which two pieces merge, with what priority and into what: a table of slots found by a multiplicative hash."""

    def __init__(self, model: Model):
        order = {rank: k for k, rank in enumerate(sorted({rank for rank, _ in model.ranks.values()}))}
        keys, values = [], []
        for piece, (rank, i) in model.ranks.items():
            for k in range(1, len(piece)):
                if (left := model.ranks.get(piece[:k])) and (right := model.ranks.get(piece[k:])):
                    keys.append(left[1] << 32 | right[1])
                    values.append(order[rank] << 32 | i)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE)
        left, found = np.array(keys, np.int64), np.array(values, np.int64)
        at = self._slot(left)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = left[free]
            own = self.keys[at] == left
            self.values[at[own]] = found[own]
            left, found, at = left[~own], found[~own], at[~own] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Priority and merged piece of each two neighbours as one number, the best the smallest; without a merge ``_NONE``."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(len(keys), _NONE)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._slot(keys[open_])
        while len(open_):
            held = self.keys[at]
            same = held == keys[open_]
            out[open_[same]] = self.values[at[same]]
            on = ~same & (held >= 0)
            open_, at = open_[on], at[on] + 1 & (1 << self.bits) - 1
        return out


@functools.lru_cache(maxsize=2)
def _pairs(model: Model) -> Pairs:
    return Pairs(model)


class Encoder:
    """Encodes on one worker; remembers how a bounded number of parts is merged without skips."""

    def __init__(self, model: Model, dropout: float, seed: int, keys: int = KEYS):
        self.model, self.seed, self.pairs = model, seed, _pairs(model)
        self.symbol = np.full(sys.maxunicode + 1, -1, np.int32)  # of each code point, where it is a piece
        for piece, (_, i) in model.ranks.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.find = re.compile(model.parts).findall
        # of a part: its ids, and the candidates its merging takes; the empty part is the sign for a space, written out in a text
        self.memo: dict[str, tuple[bytes, int]] = {}
        self.literal = np.array([model.bytes[b] for b in _SPACE_BYTES], "<i4").tobytes()
        self.keys = [zlib.crc32(b"%d %d" % (seed, v)) for v in range(keys)]
        self.gaps = _gaps(dropout) if int(dropout * (1 << 32)) else []
        self.ladder = np.array(self.gaps, np.uint64)

    def encode(self, text: str, row: str = "") -> bytes:
        """Ids as packed 32-bit numbers; ``row`` tells documents of one text apart."""
        return self.encode_all([text], [row])[0].astype("<i4").tobytes()

    def encode_all(self, texts: Sequence[str | None], rows: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        parts: list[str] = []
        counts, seeds, literals = [], [], []
        for text, row in zip(texts, rows):
            before, prefix = len(parts), SPACE
            for k, stretch in enumerate(text.split(SPACE) if text else ()):
                if k:
                    literals.append(len(parts))
                    parts.append("")
                parts += self.find(prefix + stretch.replace(" ", SPACE))
                prefix = ""
            counts.append(len(parts) - before)
            key = f"{self.seed} {row}\0{text}".encode("utf-8", "surrogatepass") if self.gaps else b""
            seeds.append(int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little"))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(len(counts), np.int64)
        different = list(dict.fromkeys(parts))
        number = dict(zip(different, range(len(different))))
        which = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
        symbols, lengths = self.symbols(different)
        first = np.cumsum(lengths) - lengths
        unknown = np.bincount(np.repeat(np.arange(len(lengths)), lengths), symbols < 0, len(lengths))
        in_step = (lengths > 0) & (lengths <= _SHORT) & (unknown == 0)
        plain = self._plain(different, symbols, first, lengths, in_step)
        pool, size = np.frombuffer(b"".join([p[0] for p in plain]), "<i4"), np.array([len(p[0]) // 4 for p in plain])
        start, length = (np.cumsum(size) - size)[which], size[which]
        if self.gaps:
            draws = _draws(np.repeat(np.array(seeds, np.uint64), counts), np.array(counts), np.array(literals, np.int64))
            gaps = np.searchsorted(self.ladder, draws >> np.uint64(32), "right")
            gaps[literals] = _LONGEST_GAP
            varied = np.flatnonzero(gaps < np.array([p[1] for p in plain])[which])
            if len(varied):
                rests = draws & np.uint64(_MASK)
                at = varied[in_step[which[varied]]]
                pools = [pool]
                if len(at):
                    own = which[at]
                    ids, sizes, _ = self.merge_in_step(_ragged(symbols, first[own], lengths[own]), lengths[own], gaps[at], rests[at])
                    start[at], length[at] = len(pool) + np.cumsum(sizes) - sizes, sizes
                    pools.append(ids)
                total = sum(map(len, pools))
                for i in varied[~in_step[which[varied]]].tolist():
                    pools.append(np.frombuffer(self.merge(parts[i], self._skips(int(gaps[i]), int(rests[i])))[0], "<i4"))
                    start[i], length[i] = total, len(pools[-1])
                    total += len(pools[-1])
                pool = np.concatenate(pools)
        text_ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(counts)]
        return _ragged(pool, start, length), np.diff(text_ends, prepend=0)

    def symbols(self, parts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The single-character pieces of all parts, one after the other (-1: none), and how many characters each has."""
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        return self.symbol[codes], np.fromiter(map(len, parts), np.int64, len(parts))

    def _plain(self, parts: list[str], symbols: np.ndarray, first: np.ndarray, lengths: np.ndarray, in_step: np.ndarray) -> list[tuple[bytes, int]]:
        """Ids and candidates of parts merged without skips."""
        out = list(map(self.memo.get, parts))
        new = np.array([found is None for found in out])
        if len(self.memo) + int(new.sum()) > _MEMO:
            self.memo.clear()
        short = np.flatnonzero(new & in_step)
        if len(short):
            ids, sizes, taken = self.merge_in_step(_ragged(symbols, first[short], lengths[short]), lengths[short])
            packed, edges = ids.astype("<i4").tobytes(), np.concatenate([[0], 4 * np.cumsum(sizes)]).tolist()
            for i, a, b, t in zip(short.tolist(), edges, edges[1:], taken.tolist()):
                out[i] = packed[a:b], t
        for i in np.flatnonzero(new & ~in_step).tolist():
            out[i] = self.merge(parts[i], iter(())) if parts[i] else (self.literal, 0)
        room = _MEMO - len(self.memo)
        kept = np.flatnonzero(new & (lengths <= _SHORT))[: max(0, room)].tolist()
        self.memo.update(zip(map(parts.__getitem__, kept), map(out.__getitem__, kept)))
        return out

    def merge_in_step(
        self, symbols: np.ndarray, lengths: np.ndarray, gaps: np.ndarray | None = None, rests: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`merge` for many short parts of known symbols at once: ids, how many each part has, candidates taken."""
        first, taken = np.cumsum(lengths) - lengths, np.zeros(len(lengths), np.int64)
        merged, low = np.full((len(lengths), int(lengths.max())), -1, np.int32), 0
        for width in _WIDTHS:
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            if len(rows):
                own = _ragged(symbols, first[rows], lengths[rows])
                found, taken[rows] = self._step(own, lengths[rows], width, None if gaps is None else gaps[rows], None if rests is None else rests[rows])
                found = found[:, : merged.shape[1]]
                merged[rows, : found.shape[1]] = found
        inside = merged >= 0
        return merged[inside], inside.sum(axis=1), taken

    def _step(self, flat: np.ndarray, lengths: np.ndarray, width: int, gaps: np.ndarray | None, rests: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Parts of one width: their symbols after merging, and the candidates taken."""
        columns, n = np.arange(width), len(lengths)
        symbols = np.full((n, width + 1), -1, np.int32)
        symbols[:, :width][columns < lengths[:, None]] = flat
        best = np.full((n, width + 1), _NONE)
        best[:, :width] = self.pairs.of(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width)
        out, counted = np.empty((n, width), np.int32), np.zeros(n, np.int64)
        own, taken, turn = np.arange(n), 0, np.zeros(n, np.int64)
        skip = np.full(n, _NONE) if gaps is None else np.where(gaps < len(self.gaps), gaps, _NONE)
        while len(own):
            place = best.argmin(axis=1)
            found = best[np.arange(len(own)), place]
            ended = found == _NONE
            if ended.any():
                out[own[ended]] = symbols[ended, :width]
                counted[own[ended]] = taken
                on = ~ended
                own, symbols, best, place, found, skip, turn = own[on], symbols[on], best[on], place[on], found[on], skip[on], turn[on]
                if not len(own):
                    break
            skipped = np.flatnonzero(skip == taken)
            taken += 1
            if len(skipped):  # a changed neighbour may propose another
                best[skipped, place[skipped]] = _NONE
                turn[skipped] += 1
                gap = np.searchsorted(self.ladder, self._keyed_all(rests[own[skipped]], turn[skipped]), "right")
                skip[skipped] = np.where(gap < len(self.gaps), taken + gap, _NONE)
                rows = np.ones(len(own), bool)
                rows[skipped] = False
                rows = np.flatnonzero(rows)
            else:
                rows = np.arange(len(own))
            at = place[rows]
            # what stands behind the merged two moves up
            source = columns + (columns > at[:, None])
            symbols[rows, :width] = symbols[rows[:, None], source]
            symbols[rows, at] = (found[rows] & np.int64(_MASK)).astype(np.int32)
            best[rows, :width] = best[rows[:, None], source]
            best[rows, at] = self.pairs.of(symbols[rows, at], symbols[rows, at + 1])
            inner = at > 0
            rows, at = rows[inner], at[inner] - 1
            best[rows, at] = self.pairs.of(symbols[rows, at], symbols[rows, at + 1])
        return out, counted

    def _keyed_all(self, rests: np.ndarray, turns: np.ndarray) -> np.ndarray:
        keys = np.array(self.keys, np.uint64)[turns % len(self.keys)]
        return _keyed(keys, rests, turns.astype(np.uint64))

    def _skips(self, gap: int, rest: int) -> Iterator[int]:
        """Numbers of the candidates to skip: the first after ``gap``, the others drawn from ``rest``."""
        at = turn = 0
        while self.gaps:
            at += gap
            if gap < len(self.gaps):
                yield at
                at += 1
            turn += 1
            gap = bisect.bisect_right(self.gaps, int(_keyed(np.uint64(self.keys[turn % len(self.keys)]), np.uint64(rest), np.uint64(turn))))

    def merge(self, part: str, skips: Iterator[int]) -> tuple[bytes, int]:
        """Agenda processing of one part, but for candidates of the rising numbers ``skips``; also how many were taken."""
        ranks, n = self.model.ranks, len(part)
        symbols: list[str | None] = list(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known, push = ranks.get, heapq.heappush
        taken, skip = 0, next(skips, -1)
        agenda = [(found[0], i, part[i : i + 2], found[1]) for i in range(n - 1) if (found := known(part[i : i + 2]))]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair, _ = heapq.heappop(agenda)
            j = after[i] if symbols[i] is not None else n
            if j >= n or symbols[i] + symbols[j] != pair:
                continue  # one of the two was merged meanwhile
            taken += 1
            if taken > skip >= 0:
                skip = next(skips, -1)
                continue  # a changed neighbour may propose another
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := known(pair + symbols[k]):
                    push(agenda, (found[0], i, pair + symbols[k], found[1]))
            h = before[i]
            if h >= 0 and (found := known(symbols[h] + pair)):
                push(agenda, (found[0], h, symbols[h] + pair, found[1]))
        ids: list[int] = []
        for s in symbols:
            if s is not None:
                if found := known(s):
                    ids.append(found[1])
                else:
                    ids += [self.model.bytes[b] for b in s.encode()]
        return struct.pack(f"<{len(ids)}i", *ids), taken


def _ragged(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after the other."""
    ends = np.cumsum(length)
    return values[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def _keyed(key: np.ndarray, rest: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """32-bit hashes of a part's draw and the turn of the skip under a key."""
    with np.errstate(over="ignore"):
        h = (key ^ rest * np.uint64(0x9E3779B1) ^ turn * np.uint64(0x85EBCA77)) & np.uint64(_MASK)
        h = (h ^ h >> np.uint64(16)) * np.uint64(0x21F0AAAD) & np.uint64(_MASK)
    return h ^ h >> np.uint64(15)


def _draws(own: np.ndarray, counts: np.ndarray, literals: np.ndarray) -> np.ndarray:
    """64 bits for each place of each text (splitmix); ``own`` has its text's seed, written-out signs have no place."""
    place = np.ones(len(own), np.int64)
    place[literals] = 0
    place = np.cumsum(place)
    ends = np.cumsum(counts)
    place -= np.repeat(np.concatenate([[0], place])[ends - counts], counts)
    h = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + own
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _gaps(dropout: float) -> list[int]:
    """32-bit numbers below which a draw skips the candidate of each place; beyond the last none of them is skipped."""
    out: list[int] = []
    while len(out) < _LONGEST_GAP and (not out or out[-1] < 1 << 32):
        out.append((1 << 32) - int((1 - dropout) ** (len(out) + 1) * (1 << 32)))
    return out


def _encoder(model: Model, dropout: float, seed: int) -> Encoder:
    """The worker's encoder, kept from task to task: merging a part anew costs a hundred times a look-up."""
    kept = sys.modules.setdefault("_palaver_encoder", types.ModuleType("_palaver_encoder"))
    key = (dropout, seed, zlib.crc32("".join(model.ranks).encode()))
    if getattr(kept, "key", None) != key:
        kept.encoder, kept.key = Encoder(model, dropout, seed), key
    return kept.encoder


def decode_ids(ids, spelled: list[bytes]) -> str:
    text = b"".join(map(spelled.__getitem__, ids)).decode()
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 11, text: str = "text", check: bool = False, by: Sequence[str] = ("doc_id", "copy")) -> DataFrame:
    """``docs`` with ``pieces``, the ids of each text.

    ``check`` adds ``lossless``: whether the ids decode to the text. A null text has null
    pieces (and is lossless), an empty one none. Control pieces written out in a text are
    ordinary text. Texts of any length are taken whole; columns of these names are replaced.
    Rows that differ in text or in a column of ``by`` (those the table has) have skips of
    their own; rows equal in all of them have the same pieces.
    """
    if not 0 <= dropout < 1:
        raise ValueError("dropout is a rate below 1")
    model = Model(model_path)
    kept = [c for c in docs.columns if c not in ("pieces", "lossless")]
    fields = [docs.schema[c] for c in kept] + [T.StructField("pieces", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields + [T.StructField("lossless", T.BooleanType())] * check)
    arrow = arrow_schema(schema)
    named = taken_names(docs.select(*kept), by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(model, dropout, seed)
        for batch in batches:
            for part in byte_slices(batch, text, _SLICE):
                texts = part.column(text).to_pylist()
                rows = map(repr, zip(*[part.column(c).to_pylist() for c in named])) if named else itertools.repeat("")
                ids, counts = own.encode_all(texts, [row for _, row in zip(texts, rows)])
                offsets = np.concatenate([[0], np.cumsum(counts)])
                nulls = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids), mask=nulls)
                columns = [*[part.column(c) for c in kept], lists.cast(arrow.field("pieces").type)]
                if check:
                    columns.append(pa.array([decode_ids(ids[a:b].tolist(), model.spelled) == (t or "") for a, b, t in zip(offsets, offsets[1:], texts)]))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        give_back()

    return docs.select(*kept).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, pieces: str = "pieces") -> DataFrame:
    """``encoded`` with ``decoded``, the text of the ids; null ids have a null text, none an empty one."""
    spelled = Model(model_path).spelled
    kept = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField("decoded", T.StringType())])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else decode_ids(ids, spelled) for ids in batch.column(pieces).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string())], schema=arrow)

    return encoded.select(*kept).mapInArrow(run, schema)
