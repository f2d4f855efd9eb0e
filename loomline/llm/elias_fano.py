"""Elias-Fano sequences and a compact n-gram trie over them, in numpy arrays that can be memory-mapped."""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"NGT1"


def _rank_words(words: np.ndarray) -> np.ndarray:
    before = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bitwise_count(words), out=before[1:])
    return before


def _select_in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th one (from 0) within each word."""
    at = np.zeros(len(words), np.int64)
    w, r = words.copy(), r.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(w & np.uint64((1 << step) - 1)).astype(np.int64)
        up = r >= low
        r -= np.where(up, low, 0)
        at += np.where(up, step, 0)
        w = np.where(up, w >> np.uint64(step), w)
    return at


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts in unary; access and successor by select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray | None = None):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.ones = _rank_words(high) if before is None else before
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        hi = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(hi[-1]) + 2 if n else 1) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, hi >> 6, np.uint64(1) << (hi & 63).astype(np.uint64))
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            off = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, part << off)
            over = off + np.uint64(bits) > 64
            np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (np.uint64(64) - off[over]))
        return cls(n, bits, low, high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        off = (at & 63).astype(np.uint64)
        a = self.low[at >> 6] >> off
        b = np.where(off > 0, self.low[(at >> 6) + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (a | b) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        w = np.searchsorted(self.ones, i, side="right") - 1
        at = (w << 6) + _select_in_word(self.high[w], i - self.ones[w])
        return ((at - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)).astype(np.int64)

    def _ones_before_zero(self, k: np.ndarray) -> np.ndarray:
        """Ones before the k-th zero (k from 0); all of them beyond the last zero."""
        some = k < self.zeros[-1]
        k = np.where(some, k, 0)
        w = np.searchsorted(self.zeros, k, side="right") - 1
        at = (w << 6) + _select_in_word(~self.high[w], k - self.zeros[w])
        return np.where(some, at - k, self.n)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value at or above x; n where there is none."""
        h = x >> self.low_bits
        at = np.where(h > 0, self._ones_before_zero(np.maximum(h - 1, 0)), 0)
        stop = self._ones_before_zero(h)
        low = (x & ((1 << self.low_bits) - 1)).astype(np.uint64)
        todo = np.flatnonzero(at < stop)
        while len(todo):
            smaller = self._low(at[todo]) < low[todo]
            todo = todo[smaller]
            at[todo] += 1
            todo = todo[at[todo] < stop[todo]]
        return at

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.ones]

    @classmethod
    def from_arrays(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:])


class NgramTrie:
    """Levels of n-grams. A level's entries are ordered by (parent entry, word); entry i has children ``[p(i), p(i + 1))``.

    Pointers are an Elias-Fano sequence. The words of a level are one too: within a parent's range they are stored
    relative to the last value of the range before, so the whole level never decreases, and a child is found by a
    successor search for the word plus its range's base. Each entry has a one-byte code into the level's code book.
    """

    def __init__(self, words: list[EliasFano], pointers: list[EliasFano], codes: list[np.ndarray], books: list[np.ndarray]):
        self.words, self.pointers, self.codes, self.books = words, pointers, codes, books

    @classmethod
    def build(cls, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> NgramTrie:
        """``levels``: (parent entry, word, value) per level, ordered by parent and word; the first level's parents are 0."""
        words, pointers, codes, books = [], [], [], []
        above = 1
        for parent, word, value in levels:
            starts = np.searchsorted(parent, np.arange(above + 1))
            pointers.append(EliasFano.of(starts))
            last = np.where(starts[1:] > starts[:-1], word[np.maximum(starts[1:], 1) - 1] + 1 if len(word) else 0, 0)
            base = np.concatenate([[0], np.cumsum(last)])[:-1]
            words.append(EliasFano.of(word + base[parent] if len(word) else word))
            code, book = quantised(value)
            codes.append(code)
            books.append(book)
            above = len(word)
        return cls(words, pointers, codes, books)

    def child(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Entry of ``word`` under each parent entry of the level above (0 at the first level); -1 if there is none."""
        seq = self.words[level]
        if not seq.n or not len(parent):
            return np.full(len(parent), -1, np.int64)
        known = parent >= 0
        p = np.where(known, parent, 0)
        lo, hi = self.pointers[level].access(p), self.pointers[level].access(p + 1)
        base = np.where(lo > 0, seq.access(np.maximum(lo - 1, 0)) + 1, 0)
        x = word + base
        at = seq.successor(x)
        inside = known & (at >= lo) & (at < hi)
        found = inside & (seq.access(np.where(inside, at, 0)) == x)
        return np.where(found, at, -1)

    def value(self, level: int, entry: np.ndarray) -> np.ndarray:
        return self.books[level][self.codes[level][entry]]

    def to_bytes(self) -> list[bytes]:
        arrays = [a for e in (*self.words, *self.pointers) for a in e.arrays()] + self.codes + self.books
        arrays = [np.ascontiguousarray(a) for a in arrays]
        table = b"".join(struct.pack("<4sQ", a.dtype.str.encode().ljust(4), len(a)) for a in arrays)
        out = [MAGIC + struct.pack("<II", len(self.words), len(arrays)) + table]
        at = len(out[0])
        for a in arrays:
            pad = -at % 8
            out.append(b"\0" * pad + a.tobytes())
            at += pad + a.nbytes
        return out

    @classmethod
    def mapped(cls, buf) -> NgramTrie:
        """A trie over a buffer such as a memory-mapped file; nothing is copied."""
        if bytes(buf[:4]) != MAGIC:
            raise ValueError("not an n-gram trie")
        k, n = struct.unpack_from("<II", buf, 4)
        at, arrays = 12 + 12 * n, []
        for i in range(n):
            kind, size = struct.unpack_from("<4sQ", buf, 12 + 12 * i)
            at += -at % 8
            arrays.append(np.frombuffer(buf, kind.strip().decode(), size, at))
            at += arrays[-1].nbytes
        ef = [EliasFano.from_arrays(arrays[4 * i : 4 * i + 4]) for i in range(2 * k)]
        return cls(ef[:k], ef[k:], arrays[8 * k : 9 * k], arrays[9 * k :])


def quantised(value: np.ndarray, cells: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """One-byte codes and their book: cells of equal width, each standing for its mean; off by at most a cell's width."""
    if not len(value):
        return np.zeros(0, np.uint8), np.zeros(1, np.float32)
    low, high = float(value.min()), float(value.max())
    width = (high - low) / cells or 1.0
    code = np.minimum((value - low) / width, cells - 1).astype(np.uint8)
    n = np.bincount(code, minlength=cells)
    return code, (np.bincount(code, value, cells) / np.maximum(n, 1)).astype(np.float32)
