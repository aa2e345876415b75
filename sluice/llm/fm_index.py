"""FM-index over a sequence of integers, with a wavelet matrix, in numpy.

Built by one task over one shard's text. Suffixes are sorted by their first
``DEPTH`` symbols (ties by position), which is enough for patterns of up to
``DEPTH`` symbols. Backward search runs for many patterns at once.
"""

from __future__ import annotations

import numpy as np

DEPTH = 32


def sort_suffixes(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions in the order of the first ``depth`` symbols, by doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, h = len(text), 1
    while h < depth and n and rank.max() < n - 1:
        after = np.zeros(n, dtype=np.int64)
        after[:max(n - h, 0)] = rank[h:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        h *= 2
    return np.argsort(rank, kind="stable")


class BitVector:
    """Bits packed into 64-bit words with the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    """rank(c, i): occurrences of symbol ``c`` among the first ``i``."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.bits: list[BitVector] = []
        self.zeros: list[int] = []
        first = np.zeros(n_symbols, dtype=np.int64)
        symbols = np.arange(n_symbols)
        for shift in range(self.levels - 1, -1, -1):
            bit = ((seq >> shift) & 1).astype(np.uint8)
            v = BitVector(bit)
            z = int(len(bit) - bit.sum())
            self.bits.append(v)
            self.zeros.append(z)
            ones = v.rank(first)
            first = np.where((symbols >> shift) & 1, z + ones, first - ones)
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        self.first = first

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (v, z) in enumerate(zip(self.bits, self.zeros)):
            ones = v.rank(i)
            i = np.where((c >> (self.levels - 1 - level)) & 1, z + ones, i - ones)
        return i - self.first[c]


class FMIndex:
    """``text``: symbols 0 .. n_symbols - 1."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        self.text = text
        self.order = sort_suffixes(text)
        self.matrix = WaveletMatrix(text[self.order - 1], n_symbols)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))

    def matching(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the ``length`` symbols from each text position
        ``at``. Returns (indexes into ``at``, interval begin, interval end) of
        those that occur at least twice. A pattern is dropped as soon as its
        interval holds one suffix: its matching statistic stays below
        ``length`` but for its own place."""
        c = self.text[at + length - 1]
        lo, hi = self.starts[c], self.starts[c + 1]
        live = np.arange(len(at))
        for step in range(length - 2, -1, -1):
            more = hi - lo > 1
            if not more.all():
                live, lo, hi = live[more], lo[more], hi[more]
            if not len(live):
                break
            c = self.text[at[live] + step]
            lo = self.starts[c] + self.matrix.rank(c, lo)
            hi = self.starts[c] + self.matrix.rank(c, hi)
        more = hi - lo > 1
        return live[more], lo[more], hi[more]

    def earliest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest text position among the suffixes of each interval."""
        if not len(lo):
            return np.zeros(0, dtype=np.int64)
        # intervals of patterns of one length are equal or disjoint
        begin, inverse = np.unique(lo, return_inverse=True)
        end = np.zeros(len(begin), dtype=np.int64)
        end[inverse] = hi
        cuts = np.empty(2 * len(begin), dtype=np.int64)
        cuts[0::2], cuts[1::2] = begin, end
        order = np.append(self.order, len(self.order))       # an interval may end at the end
        return np.minimum.reduceat(order, cuts)[0::2][inverse]
