"""FM-index over integer sequences: wavelet-matrix ranks and sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, separator: int = 0) -> np.ndarray:
    """Starts of the suffixes in order; every separator is a symbol of its own, below all others.

    Prefix doubling: ranks of 2h symbols come from sorting pairs of ranks of h.
    Separators differ from each other, so the depth is bounded by the longest
    run between two of them.
    """
    n = len(text)
    cuts = text == separator
    rank = np.where(cuts, np.cumsum(cuts) - 1, text.astype(np.int64) + int(cuts.sum()))
    order = np.argsort(rank, kind="stable")
    h = 0
    while True:
        if h:
            after = np.zeros(n, np.int64)
            after[: n - h] = rank[h:] + 1
            key = rank * np.int64(n + 1) + after
            order = np.argsort(key, kind="stable")
        else:
            key = rank
        new = np.ones(n, bool)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all() or h >= n:
            return order
        h = max(1, 2 * h)


class WaveletMatrix:
    """Ranks of symbols in a sequence; one bit vector with running counts for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        seq = symbols
        for bit in range(bits - 1, -1, -1):
            ones = (seq >> bit & 1).astype(bool)
            before = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(seq) - int(before[-1])
            self.levels.append((bit, ones, before, zeros))
            seq = np.concatenate([seq[~ones], seq[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        low = np.zeros_like(at)
        for bit, _, before, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            a, b = before[low], before[at]
            low = np.where(one, zeros + a, low - a)
            at = np.where(one, zeros + b, at - b)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """Symbols at the positions."""
        out = np.zeros(len(at), np.int64)
        for bit, ones, before, zeros in self.levels:
            one = ones[at]
            out |= one.astype(np.int64) << bit
            b = before[at]
            at = np.where(one, zeros + b, at - b)
        return out


class FMIndex:
    """Backward search and location in one sequence of symbols 1..largest, with 0 between documents.

    The sequence must end with a separator. A step back from a separator is never
    taken: patterns hold none, and position 0 and every position that follows a
    separator keep their suffix positions.
    """

    def __init__(self, text: np.ndarray, largest: int, sample: int = 8) -> None:
        order = suffix_array(text)
        self.n = len(text)
        last = text[order - 1]
        self.bits = max(1, int(largest).bit_length())
        self.wavelet = WaveletMatrix(last, self.bits)
        counts = np.bincount(text, minlength=largest + 2)
        self.first = np.cumsum(counts) - counts
        self.sampled = (order % sample == 0) | (last == 0)
        self.positions = order[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range [low, high) of suffixes that begin with each pattern (rows of equal length)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            low[alive] = self.first[c] + self.wavelet.rank(c, low[alive])
            high[alive] = self.first[c] + self.wavelet.rank(c, high[alive])
            alive = alive[high[alive] > low[alive]]
            if not len(alive):
                break
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix, by steps back to a sampled one."""
        rows = rows.astype(np.int64)
        out = np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        at = rows
        while len(todo):
            known = self.sampled[at]
            out[todo[known]] = self.positions[self.sample_rank[at[known]]] + steps
            todo, at = todo[~known], at[~known]
            if len(todo):
                c = self.wavelet.access(at)
                at = self.first[c] + self.wavelet.rank(c, at)
                steps += 1
        return out
