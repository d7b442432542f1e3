"""Hashes of words and of runs of words, for a whole Arrow column at once.

All arithmetic is modulo 2^64 on numpy arrays. A run's hash is a difference of prefix sums
of powers, shifted back by the inverse power, so every window of a text costs the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from palaver.llm.common import ship

ship(__name__)

_SLICE = 1 << 20
_SEED = 0x5EED
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xA24BAED4963EE407)
_BYTES = np.random.Generator(np.random.PCG64(_SEED)).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse."""
    up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the word (the usual 64-bit finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of a string column: where each starts and ends, its hash, and each text's range of words."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, hashes: bool = True):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.bytes = self.bytes[offsets[0] : offsets[-1]] if len(texts) else self.bytes[:0]
        self.offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
        space = _SPACE[self.bytes]
        # a text's first byte starts a word whatever the text before ends with
        left, right = np.ones(len(space) + 1, bool), np.ones(len(space) + 1, bool)
        left[1:], right[:-1] = space, space
        left[self.offsets] = right[self.offsets] = True
        self.starts = np.flatnonzero(~space & left[:-1])
        self.ends = np.flatnonzero(~space & right[1:]) + 1
        self.first = np.searchsorted(self.starts, self.offsets)  # of each text, and the total
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.first))
        if hashes:
            self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        out, at = np.empty(len(self.starts), np.uint64), 0
        up = down = np.zeros(0, np.uint64)
        while at < len(out):
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + _SLICE, "right")))
            high = self.ends[to - 1]
            if len(up) < high - low + 1:
                up, down = powers(_BASES[0], int(high - low) + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTES[self.bytes[low:high]] * up[: high - low], out=sums[1:])
            start, end = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
            at = to
        return out

    def runs(self, length: int, base: int = 1, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the runs of ``length`` words that start at each word (or at ``at``).

        Runs may cross into the next text: see :meth:`whole`. Too close to the end the value is 0.
        """
        n = len(self.hashes)
        up, down = powers(_BASES[base], n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * up[:n], out=sums[1:])
        start = np.arange(n) if at is None else at
        inside = start + length <= n
        out = np.zeros(len(start), np.uint64)
        start = start[inside]
        out[inside] = mixed((sums[start + length] - sums[start]) * down[start])
        return out

    def whole(self, length: int) -> np.ndarray:
        """Whether the run that starts at each word ends within its text."""
        return np.arange(len(self.starts)) + length <= self.first[1:][self.text_of]
