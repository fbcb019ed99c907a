"""Words of many texts as arrays: distinct words with hashed features, and sequences that refer to them."""

from __future__ import annotations

import numpy as np

from corpuscope.llm.common import byte_table, encode, mix64, word_hashes

#: Bytes between words once A-Z are lower case: every ASCII character but digits and letters.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]

_OPEN, _CLOSE = 0x3C, 0x3E  # < and > stand for the ends of a word

#: Positions of spelled words that are worked on at once.
_POSITIONS = 1 << 16


class WordBatch:
    """``ids`` is the sequence of words as indices of distinct words; text i has ``ids[first[i]:first[i + 1]]``."""

    def __init__(self, texts, table: np.ndarray | None = None):
        table = byte_table(SEPARATORS) if table is None else table
        parts = [encode(t) for t in texts]
        buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        start, end, h = word_hashes(buf, table)
        ends = np.cumsum([len(p) + 1 for p in parts])
        self.first = np.concatenate(([0], np.searchsorted(start, ends))).astype(np.int64)
        self.hashes, at, self.ids = np.unique(h, return_index=True, return_inverse=True)
        self.ids = self.ids.ravel()
        self._spell(buf, start[at], end[at])

    def _spell(self, buf, start, end):
        """The distinct words in one buffer, each between marks, in lower case."""
        n = end - start + 2
        self.begin = np.cumsum(n) - n
        size = int(n.sum())
        word = np.repeat(np.arange(len(n)), n)
        inside = np.arange(size) - self.begin[word]
        source = np.clip(start[word] + inside - 1, 0, len(buf) - 1)
        spelled = buf[source] if size else np.zeros(0, np.uint8)
        spelled = np.where((spelled >= 65) & (spelled <= 90), spelled + 32, spelled)
        spelled[inside == 0] = _OPEN
        spelled[inside == n[word] - 1] = _CLOSE
        self.spelled, self.left = spelled, n[word] - inside  # bytes from here to the word's end

    def features(self, sizes, bits: int, begin: int = 0, end: int | None = None):
        """Feature ids of every n-gram of the marked words, one array a size; 0 where none begins.

        Of the positions from ``begin`` to ``end`` of the spelled words; in blocks, so that little else is held.
        """
        end = len(self.spelled) if end is None else end
        out = [np.zeros(end - begin, np.int32) for _ in sizes]
        table = byte_table([], lower=False)
        for at in range(begin, end, _POSITIONS):
            stop = min(at + _POSITIONS, end)
            value = table[self.spelled[at : stop + max(sizes)]]
            value = np.concatenate((value, np.zeros(stop - at + max(sizes) - len(value), np.uint64)))
            h = np.zeros(stop - at, np.uint64)
            for n in range(1, max(sizes) + 1):
                h = h * np.uint64(0x9E3779B97F4A7C15) + value[n - 1 : n - 1 + len(h)]
                if n in sizes:
                    f = (mix64(h + np.uint64(n)) & np.uint64((1 << bits) - 1)).astype(np.int32)
                    out[sizes.index(n)][at - begin : stop - begin] = np.where(self.left[at:stop] >= n, np.maximum(f, 1), 0)
        return out

    def word_feature(self, bits: int):
        """The feature of each distinct word as a whole."""
        return np.maximum((mix64(self.hashes) & np.uint64((1 << bits) - 1)).astype(np.int64), 1)

    def sums(self, weights: np.ndarray, sizes, bits: int) -> np.ndarray:
        """For each distinct word, the sum of the rows of ``weights`` (row 0 is zero) of its n-grams."""
        out = np.zeros((len(self.hashes), weights.shape[1]), weights.dtype)
        ends = np.append(self.begin[1:], len(self.spelled)) if len(self.begin) else self.begin
        first = 0
        while first < len(self.begin):
            last = max(first + 1, int(np.searchsorted(ends, self.begin[first] + _POSITIONS, side="right")))
            lo, hi = int(self.begin[first]), int(ends[last - 1])
            total = None
            for f in self.features(sizes, bits, lo, hi):
                total = weights[f] if total is None else total + weights[f]
            out[first:last] = np.add.reduceat(total, self.begin[first:last] - lo, axis=0)
            first = last
        return out
