"""An FM-index over word ids: suffix order, wavelet-matrix ranks, sampled positions (numpy)."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` in suffix order by prefix doubling; zeros are separators, each distinct.

    Separators end every comparison, so the rounds follow the longest segment, not the text.
    """
    n = len(text)
    rank = text.astype(np.int64)
    zero = text == 0
    rank[~zero] += int(zero.sum())
    rank[zero] = np.arange(int(zero.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        sorted_rank = rank[order]
        new = np.empty(n, np.int64)
        if step == 1:
            new[order] = np.concatenate(([0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])))
            rank, last = new, int(new.max(initial=0))
        if last == n - 1:
            return np.argsort(rank, kind="stable")
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank, last, step = new, int(new.max(initial=0)), step * 2


class WaveletMatrix:
    """Ranks and accesses over symbols, one bit level a time, for whole arrays of queries."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for b in range(bits - 1, -1, -1):
            on = ((symbols >> b) & 1).astype(bool)
            ones = np.concatenate(([0], np.cumsum(on, dtype=np.int32)))
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((b, ones, zeros))
            symbols = np.concatenate((symbols[~on], symbols[on]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        at, base = at.astype(np.int64), np.zeros(len(at), np.int64)
        for b, ones, zeros in self.levels:
            on = ((symbol >> b) & 1).astype(bool)
            at = np.where(on, zeros + ones[at], at - ones[at])
            base = np.where(on, zeros + ones[base], base - ones[base])
        return at - base

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for b, ones, zeros in self.levels:
            on = ones[at + 1] > ones[at]
            symbol |= on.astype(np.int64) << b
            at = np.where(on, zeros + ones[at], at - ones[at])
        return symbol


class FmIndex:
    """Backward search and location of phrases in ``text`` (symbols from 1; 0 separates and ends it)."""

    def __init__(self, text: np.ndarray, alphabet: int, every: int = 8):
        order = suffix_order(text)
        before = text[order - 1]  # of position 0: the last, a separator
        self.bwt = WaveletMatrix(before.astype(np.int64), max(1, int(alphabet).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet + 1))))
        # Steps back never cross a separator: the starts of segments are always sampled.
        kept = (order % every == 0) | (before == 0)
        self.kept_before = np.concatenate(([0], np.cumsum(kept, dtype=np.int64)))
        self.positions = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of one length, a row each."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.first[-1], np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, k]
            base = self.first[symbol]
            lo, hi = base + self.bwt.rank(symbol, lo), base + self.bwt.rank(symbol, hi)
            hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase number, position) of every occurrence in the ranges."""
        many = hi - lo
        who = np.repeat(np.arange(len(lo)), many)
        row = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + lo[who]
        steps, at = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        open_ = np.arange(len(row))
        while len(open_):
            r = row[open_]
            known = self.kept_before[r + 1] > self.kept_before[r]
            done = open_[known]
            at[done] = self.positions[self.kept_before[r[known]]] + steps[done]
            open_, r = open_[~known], r[~known]
            if len(open_):
                symbol = self.bwt.access(r)
                row[open_] = self.first[symbol] + self.bwt.rank(symbol, r)
                steps[open_] += 1
        return who, at
