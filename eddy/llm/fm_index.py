"""An FM-index over integer sequences: suffix order, wavelet-matrix ranks, sampled positions.

Everything is numpy over one shard, whose length the caller bounds."""

from __future__ import annotations

import numpy as np


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of `seq` (int64, values >= 0) in order, by doubling the
    compared length; only suffixes that are still equal are sorted again."""
    n = len(seq)
    if n == 0:
        return np.zeros(0, "<i8")
    base = int(seq.max()) + 2
    if base < 1 << 21:      # three symbols fit in one key
        wide = np.concatenate([seq + 1, [0, 0]])
        key, h = (wide[:n] * base + wide[1:n + 1]) * base + wide[2:n + 2], 3
    else:
        key, h = seq, 1
    order = np.argsort(key)
    rank = np.empty(n, "<i8")
    at = np.arange(n)       # places of the order that are still open
    key = key[order]
    part = order
    while True:
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        counts = np.diff(np.concatenate([starts, [len(at)]]))
        rank[part] = np.repeat(at[starts], counts)
        order[at] = part
        still = np.repeat(counts > 1, counts)
        at, part = at[still], part[still]
        if not len(at):
            return order
        ahead = part + h
        key = rank[part] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        part, key = part[by], key[by]
        h *= 2


class WaveletMatrix:
    """rank(symbol, i): occurrences of the symbol in the first i values; access(i) with the rank."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        v = values.astype("<u4")
        for level in range(bits - 1, -1, -1):
            bit = (v >> np.uint32(level)) & np.uint32(1)
            ones = np.zeros(len(v) + 1, "<i4")
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(v) - int(ones[-1]))
            up = bit.astype(bool)
            v = np.concatenate([v[~up], v[up]])

    def map(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a prefix of length `at` ends among the symbol's own values; differences are ranks."""
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[k][at]
            at = np.where((symbols >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, mapped places) of the rows `at`."""
        value = np.zeros(len(at), "<i8")
        for k in range(self.bits):
            here = self.ones[k][at]
            bit = self.ones[k][at + 1] - here
            value = value * 2 + bit
            at = np.where(bit, self.zeros[k] + here, at - here)
        return value, at


class FMIndex:
    """Index of documents given as arrays of symbols from 1 on (0 separates them)."""

    def __init__(self, docs: list[np.ndarray], sample: int = 8):
        sizes = np.array([len(d) for d in docs], "<i8")
        ends = np.cumsum(sizes + 1) - 1                       # places of the separators
        n = int(ends[-1]) + 1 if len(ends) else 0
        text = np.zeros(n, "<i8")
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = np.concatenate(docs) if docs else []
        self.starts = np.concatenate([[0], ends[:-1] + 1]) if n else ends
        distinct = text + len(docs)
        distinct[ends] = np.arange(len(docs))                 # separators differ, so order ends at them
        order = suffix_order(distinct)
        last = np.where(order > 0, text[order - 1], 0)
        top = int(text.max(initial=0)) + 1
        self.size, self.top = n, top
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))])
        self.tree = WaveletMatrix(last, max(1, int(top - 1).bit_length()))
        self.begin = self.tree.map(np.arange(top), np.zeros(top, "<i8"))
        # sampled: every `sample`-th place, and document starts, before which no walk goes
        marked = np.zeros(n, bool)
        marked[::sample] = True
        marked[self.starts] = True
        self.marked = marked[order]
        self.place = np.concatenate([[0], np.cumsum(self.marked)])
        self.known = order[self.marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of patterns (rows of equal length, symbols from 1 on), by backward
        search; patterns leave the search as soon as nothing matches."""
        lo = np.zeros(len(patterns), "<i8")
        hi = np.full(len(patterns), self.size, "<i8")
        live = np.flatnonzero((patterns > 0).all(1) & (patterns < self.top).all(1))
        hi[np.setdiff1d(np.arange(len(patterns)), live)] = 0
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            begin = self.first[c] - self.begin[c]
            lo[live] = begin + self.tree.map(c, lo[live])
            hi[live] = begin + self.tree.map(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of rows: step back to a sampled one and add the steps."""
        rows = rows.copy()
        out = np.zeros(len(rows), "<i8")
        steps, left = 0, np.arange(len(rows))
        while len(left):
            done = self.marked[rows[left]]
            got = left[done]
            out[got] = self.known[self.place[rows[got]]] + steps
            left = left[~done]
            c, at = self.tree.access(rows[left])
            rows[left] = self.first[c] + at - self.begin[c]
            steps += 1
        return out
