"""Suffix arrays of many word sequences at once, their LCP arrays, and range minima, in numpy.

A batch of sequences is one array of letters in which every sequence ends in a letter of its own, smaller than its others, and
the letters of a later sequence are larger than all of an earlier one. So suffixes of different sequences never compare equal, and a batch costs what its sequences cost.
"""

from __future__ import annotations

import numpy as np

ROW = 16
SLICE = 1 << 14  # queries answered at a time
MOST = np.iinfo(np.int64).max


class RangeMin:
    """Minima of ranges: a sparse table over rows of ROW values, and the values of the two rows at the ends."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.rows = np.concatenate([values, np.full(-len(values) % ROW, MOST, values.dtype if values.dtype == np.int64 else np.int64)]).reshape(-1, ROW)
        self.tables = [self.rows.min(axis=1)] if len(self.rows) else [np.zeros(0, np.int64)]
        while len(self.tables[-1]) > (step := 1 << (len(self.tables) - 1)):
            self.tables.append(np.minimum(self.tables[-1][:-step], self.tables[-1][step:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of values[low..high], both ends included."""
        return np.concatenate([self._least(low[i : i + SLICE], high[i : i + SLICE]) for i in range(0, len(low), SLICE)] or [np.zeros(0, np.int64)])

    def _least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        first, last, at = low // ROW, high // ROW, np.arange(ROW)
        ends = (high % ROW)[:, None]
        left = (at >= (low % ROW)[:, None]) & ((at <= ends) | (first != last)[:, None])
        out = np.where(left, self.rows[first], MOST).min(axis=1)
        out = np.minimum(out, np.where((at <= ends) & (first != last)[:, None], self.rows[last], MOST).min(axis=1))
        between = last - first - 1
        level = np.frexp(np.maximum(between, 1).astype(np.float64))[1] - 1
        for k in np.unique(level[between > 0]).tolist():
            own = np.flatnonzero((between > 0) & (level == k))
            table = self.tables[k]
            out[own] = np.minimum(out[own], np.minimum(table[first[own] + 1], table[last[own] - (1 << k)]))
        return out

    def first_below(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from start on whose value is below the bound, or the number of values."""
        return np.concatenate([self._first_below(start[i : i + SLICE], bound[i : i + SLICE]) for i in range(0, len(start), SLICE)] or [np.zeros(0, np.int64)])

    def _first_below(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        out = np.full(len(start), self.size, np.int64)
        inside = np.flatnonzero(start < self.size)
        row = start[inside] // ROW
        hit = (self.rows[row] < bound[inside][:, None]) & (np.arange(ROW) >= (start[inside] % ROW)[:, None])
        found = hit.any(axis=1)
        out[inside[found]] = row[found] * ROW + hit[found].argmax(axis=1)
        inside, row = inside[~found], row[~found] + 1
        for k in range(len(self.tables) - 1, -1, -1):  # rows to skip, in binary
            table = self.tables[k]
            skip = np.flatnonzero(row < len(table))
            skip = skip[table[row[skip]] >= bound[inside[skip]]]
            row[skip] += 1 << k
        left = row < len(self.rows)
        inside, row = inside[left], row[left]
        out[inside] = row * ROW + (self.rows[row] < bound[inside][:, None]).argmax(axis=1)
        return out


def suffix_array(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse, and common prefix lengths of neighbours (entry k: of suffixes k - 1 and k).

    Groups of suffixes with equal first h letters are split by what follows, h doubling; only groups of several go on. Where a group
    splits, the two neighbours share h letters and as many as the suffixes h further on, a range minimum of the lengths known so far.
    """
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    lcp = np.zeros(n, np.int64)
    same = np.zeros(n, bool)
    same[1:] = letters[order][1:] == letters[order][:-1]
    lcp[same] = MOST
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    several = same.copy()
    several[:-1] |= same[1:]
    at, h = np.flatnonzero(several), 1
    while len(at):
        suffix = order[at]
        group, after = rank[suffix], rank[suffix + h]  # the last letter of a sequence stands once, so suffix + h is inside
        sorted_ = np.argsort(group * n + after, kind="stable")
        suffix, group, after = suffix[sorted_], group[sorted_], after[sorted_]
        order[at] = suffix
        head = np.ones(len(at), bool)
        head[1:] = group[1:] != group[:-1]
        split = np.zeros(len(at), bool)
        split[1:] = ~head[1:] & (after[1:] != after[:-1])
        cut = np.flatnonzero(split)
        lcp[at[cut]] = h if h == 1 else h + RangeMin(lcp).least(after[cut - 1] + 1, after[cut])
        start = head | split
        rank[suffix] = at[np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))]
        several = ~start
        several[:-1] |= ~start[1:]
        at, h = at[several], h * 2
    return order, rank, lcp


def next_smaller(values: np.ndarray, near: int = 8) -> np.ndarray:
    """For each place the next one with a smaller value, or the number of values: `near` steps for all, then by range minima."""
    n = len(values)
    out, left = np.full(n, n, np.int64), np.arange(n)
    for step in range(1, near + 1):
        left = left[left + step < n]
        smaller = values[left + step] < values[left]
        out[left[smaller]] = left[smaller] + step
        left = left[~smaller]
    if len(left):
        out[left] = RangeMin(values).first_below(left + near + 1, values[left])
    return out
