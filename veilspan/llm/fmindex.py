"""An FM-index over a sequence of small integers: suffix array by doubling, wavelet matrix over the BWT, batched
backward search, and locating by sampled suffix positions. All queries of a batch move together through numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(t: np.ndarray) -> np.ndarray:
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(0, s[1:] != s[:-1]))
        rank, k = new, 2 * k
        if k >= n or rank[order[-1]] == n - 1:
            return order


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = []
        seq = seq.astype(np.int64)
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            b = (seq >> bit) & 1
            ones = np.zeros(len(seq) + 1, np.int64)
            np.cumsum(b, out=ones[1:])
            self.levels.append((bit, ones, len(seq) - int(ones[-1])))
            seq = np.concatenate([seq[b == 0], seq[b == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before i, for each pair."""
        lo = np.zeros_like(i)
        for bit, ones, zeros in self.levels:
            up = ((c >> bit) & 1).astype(bool)
            lo = np.where(up, zeros + ones[lo], lo - ones[lo])
            i = np.where(up, zeros + ones[i], i - ones[i])
        return i - lo


class FMIndex:
    """text: integers above 0; `sample`: every how many positions a suffix position is kept."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        t = np.append(text, 0).astype(np.int64)
        sa = suffix_array(t)
        self.bwt = t[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma + 1))])
        self.wm = WaveletMatrix(self.bwt, sigma + 1)
        self.known = sa % sample == 0
        self.at = np.cumsum(self.known) - 1
        self.kept = sa[self.known]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of equally long patterns (rows)."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k].astype(np.int64)
            lo[live] = self.first[c] + self.wm.rank(c, lo[live])
            hi[live] = self.first[c] + self.wm.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        hi = np.maximum(lo, hi)
        dead = np.ones(len(patterns), bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: LF steps to the next sampled row."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            got = self.known[r]
            out[todo[got]] = self.kept[self.at[r[got]]] + steps
            todo = todo[~got]
            c = self.bwt[rows[todo]]
            rows[todo] = self.first[c] + self.wm.rank(c, rows[todo])
            steps += 1
        return out
