"""An FM-index over a shard of short texts: Burrows-Wheeler transform in a wavelet matrix of packed bits.

Suffixes are sorted by their first ``depth`` characters only, which is enough for backward search of patterns up to that
length: a pattern's interval is then exact whichever way longer ties are broken. All queries of a batch advance together,
one character a step, with numpy gathers in place of per-query loops; queries whose interval becomes too small drop out.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank queries over a sequence of small integers in about 1.5 bits a symbol and level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n = len(symbols)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.blocks, self.zeros = [], [], []
        seq = symbols.astype(np.uint32)
        for level in reversed(range(self.levels)):
            bits = ((seq >> np.uint32(level)) & np.uint32(1)).astype(np.uint8)
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
            padded[: self.n] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            blocks = np.zeros(len(words) + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(words), out=blocks[1:])
            self.words.append(words)
            self.blocks.append(blocks)
            zero = bits == 0
            self.zeros.append(int(zero.sum()))
            seq = np.concatenate([seq[zero], seq[~zero]])

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.blocks[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] stands before position at[i]."""
        begin, end = np.zeros(len(at), dtype=np.int64), at.astype(np.int64)
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            ones_b, ones_e = self._rank1(k, begin), self._rank1(k, end)
            begin = np.where(bit == 1, self.zeros[k] + ones_b, begin - ones_b)
            end = np.where(bit == 1, self.zeros[k] + ones_e, end - ones_e)
        return end - begin


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a cyclic sequence sorted by their first ``depth`` characters at least, by prefix doubling."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    width = 1
    order = np.argsort(rank, kind="stable")
    while width < depth:
        key = rank * (n + 1) + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank, width = new, width * 2
        if rank[order[-1]] == n - 1:
            break
    return order


class FMIndex:
    def __init__(self, texts: list[np.ndarray], depth: int):
        """texts: arrays of code points; each is closed by a separator that no query has."""
        self.starts = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.starts[1:])
        whole = np.zeros(int(self.starts[-1]), dtype=np.int64)
        for t, s in zip(texts, self.starts, strict=False):
            whole[s : s + len(t)] = t.astype(np.int64) + 1
        self.alphabet, symbols = np.unique(whole, return_inverse=True)
        self.depth = depth
        self.order = suffix_order(symbols, depth)
        self.bwt = WaveletMatrix(symbols[self.order - 1], len(self.alphabet))
        counts = np.bincount(symbols, minlength=len(self.alphabet))
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])

    def search(self, patterns: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of equally long patterns (rows of code points): (lo, hi, matched).

        matched is the sampled matching statistic: how many characters from the pattern's end occur at least ``least``
        times; lo and hi bound the interval of those occurrences.
        """
        m, width = patterns.shape
        assert width <= self.depth
        lo, hi = np.zeros(m, dtype=np.int64), np.full(m, self.bwt.n, dtype=np.int64)
        matched = np.zeros(m, dtype=np.int64)
        live = np.arange(m)
        codes = patterns.astype(np.int64) + 1
        for s in reversed(range(width)):
            symbol = np.searchsorted(self.alphabet, codes[live, s])
            known = (symbol < len(self.alphabet)) & (self.alphabet[np.minimum(symbol, len(self.alphabet) - 1)] == codes[live, s])
            live, symbol = live[known], symbol[known]
            if not len(live):
                break
            ranks = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo[live], hi[live]]))
            a, b = self.first[symbol] + ranks[: len(live)], self.first[symbol] + ranks[len(live) :]
            go = b - a >= least
            live = live[go]
            lo[live], hi[live] = a[go], b[go]
            matched[live] += 1
        return lo, hi, matched

    def locate(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, offset) of the occurrences in an interval."""
        at = self.order[lo:hi]
        text = np.searchsorted(self.starts, at, side="right") - 1
        return text, at - self.starts[text]
