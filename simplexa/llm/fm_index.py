"""An FM-index over a sequence of small integers, vectorised over patterns and rows.

The Burrows-Wheeler transform is kept as a wavelet matrix (one bit vector with running
counts a level), which answers rank and access; suffix positions are sampled.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s``, whose last symbol is its unique smallest, by prefix doubling."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank = rank.astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        k *= 2
        if k >= n:
            return np.argsort(rank, kind="stable")


class WaveletMatrix:
    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        self.zeros: list[int] = []
        v = values
        for level in range(self.levels - 1, -1, -1):
            bit = (v >> level) & 1
            self.bits.append(bit.astype(np.int8))
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(int(len(v) - bit.sum()))
            v = np.concatenate((v[bit == 0], v[bit == 1]))

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start, end = np.zeros_like(places), places.copy()
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = (symbols >> level) & 1 == 1
            s1, e1 = self.ones[i][start], self.ones[i][end]
            start = np.where(bit, self.zeros[i] + s1, start - s1)
            end = np.where(bit, self.zeros[i] + e1, end - e1)
        return end - start

    def access(self, places: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(places), places.copy()
        for i in range(self.levels):
            bit = self.bits[i][at] == 1
            out = out * 2 + bit
            one = self.ones[i][at]
            at = np.where(bit, self.zeros[i] + one, at - one)
        return out


class FMIndex:
    """Over ``s``: symbols 1 and above; 0 is added as the terminator."""

    def __init__(self, s: np.ndarray, sigma: int, sample: int = 16):
        s = np.concatenate((s.astype(np.int64), [0]))
        sa = suffix_array(s)
        self.n = len(s)
        self.wavelet = WaveletMatrix(s[sa - 1], sigma)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=sigma))))
        self.marked = sa % sample == 0
        self.mark_rank = np.cumsum(self.marked) - 1
        self.samples = sa[self.marked]

    def search(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 row of each pattern, by backward search; equal where it is absent."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        sizes = np.array([len(p) for p in patterns])
        flat = np.concatenate(patterns)
        ends = np.cumsum(sizes)
        for step in range(1, int(sizes.max()) + 1):
            live = np.flatnonzero((sizes >= step) & (lo < hi))
            if not len(live):
                break
            c = flat[ends[live] - step]
            lo[live] = self.before[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.before[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Suffix positions of rows: walk backwards until a sampled one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            done = self.marked[at[todo]]
            hit = todo[done]
            out[hit] = self.samples[self.mark_rank[at[hit]]] + steps[hit]
            todo = todo[~done]
            c = self.wavelet.access(at[todo])
            at[todo] = self.before[c] + self.wavelet.rank(c, at[todo])
            steps[todo] += 1
        return out
