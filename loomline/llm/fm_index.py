"""FM-index over integer words: suffix sorting, wavelet-tree ranks, backward search and sampled positions, in numpy."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank: packed words and the count of ones before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)


class WaveletTree:
    """Wavelet tree, its levels stored as a matrix: level by level all zeros of a bit before all ones."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        self.shifts = list(range(max(1, int(sigma - 1).bit_length())))[::-1]
        for s in self.shifts:
            bit = (seq >> s & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        every = np.arange(sigma, dtype=np.int64)
        self.start = self._down(every, np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for s, level, zeros in zip(self.shifts, self.levels, self.zeros, strict=True):
            ones = level.rank(i)
            i = np.where(c >> s & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i."""
        return self._down(c, i) - self.start[c]

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at position i and its occurrences before i."""
        c = np.zeros(len(i), np.int64)
        for s, level, zeros in zip(self.shifts, self.levels, self.zeros, strict=True):
            bit, ones = level.get(i), level.rank(i)
            c |= bit.astype(np.int64) << s
            i = np.where(bit, zeros + ones, i - ones)
        return c, i - self.start[c]


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Rank of each suffix of ``text``, whose zeros are separators, each smaller than all symbols and than later zeros.

    The last symbol must be 0. Prefix doubling that sorts only suffixes not told apart so far.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    first = np.concatenate([[True], np.diff(text[order]) != 0])
    n_zero = int((text == 0).sum())
    first[:n_zero] = True
    heads = np.flatnonzero(first)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    sizes = np.repeat(np.diff(np.append(heads, n)), np.diff(np.append(heads, n)))
    todo, h = order[sizes > 1], 1
    while len(todo):
        a, b = rank[todo], rank[todo + h]
        by = np.lexsort((b, a))
        todo, a, b = todo[by], a[by], b[by]
        new_a = np.concatenate([[True], a[1:] != a[:-1]])
        new = new_a | np.concatenate([[True], b[1:] != b[:-1]])
        heads = np.flatnonzero(new)
        group = np.diff(np.append(heads, len(todo)))
        place = np.arange(len(todo)) - np.repeat(np.flatnonzero(new_a), np.diff(np.append(np.flatnonzero(new_a), len(todo))))
        rank[todo] = np.repeat(a[heads] + place[heads], group)
        todo = todo[np.repeat(group, group) > 1]
        h *= 2
    return rank


class FMIndex:
    """Index of segments of symbols 1 to ``sigma - 1``, each ended by a 0; patterns hold no 0."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 16):
        n = len(text)
        rank = suffix_ranks(text)
        suffix = np.empty(n, np.int64)
        suffix[rank] = np.arange(n)
        bwt = text[suffix - 1].astype(np.int64)
        self.n = n
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:sigma]
        self.tree = WaveletTree(bwt, sigma)
        # every sample-th position, and every start of a segment: no walk crosses a separator
        kept = (suffix % sample == 0) | (bwt == 0)
        self.marked, self.samples = Bits(kept), suffix[kept]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the rows of ``patterns``: those that occur, and their first and past-the-last suffix."""
        alive = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j].astype(np.int64)
            lo, hi = self.below[c] + self.tree.rank(c, lo), self.below[c] + self.tree.rank(c, hi)
            some = lo < hi
            alive, lo, hi = alive[some], lo[some], hi[some]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to a sampled one."""
        out, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(rows):
            done = self.marked.get(rows)
            out[at[done]] = self.samples[self.marked.rank(rows[done])] + steps
            rows, at = rows[~done], at[~done]
            c, before = self.tree.at(rows)
            rows = self.below[c] + before
            steps += 1
        return out
