"""A word-level FM-index of bounded pattern length, on numpy.

Suffixes are sorted by their first ``depth`` words, which is all that patterns
of up to ``depth`` words can tell apart: interval arithmetic on the
Burrows-Wheeler transform is exact for them.  Occurrence counts come from a
wavelet matrix, a few bits a word with 64-bit blocks for constant-time rank.
Queries run for many patterns side by side.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """rank(c, i): how often symbol c occurs before position i, for arrays of c and i."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.levels = []
        n = len(symbols)
        for k in range(self.bits - 1, -1, -1):
            ones = (symbols >> k) & 1 == 1
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(ones, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])).astype(np.int32)
            zeros = n - int(ones.sum())
            self.levels.append((words, before, zeros, k))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))
        self.starts = self._down(np.arange(alphabet), np.zeros(alphabet, np.int64))

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(words[block] & mask)

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i comes to stand on the way down to symbol c."""
        for words, before, zeros, k in self.levels:
            ones = self._ones(words, before, i)
            i = np.where((c >> k) & 1 == 1, zeros + ones, i - ones)
        return i

    def ranks(self, c: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rank(c, left) and rank(c, right)."""
        start = self.starts[c]
        return self._down(c, left) - start, self._down(c, right) - start


class FMIndex:
    """Of texts given as one array of symbols from 1 up, each text followed by a 0."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.depth, self.alphabet, n = depth, int(symbols.max(initial=0)) + 1, len(symbols)
        ranks = {1: symbols.astype(np.int64)}  # these go when the index is built
        length = 1
        while length < depth:  # ranks by twice as many symbols, or by as many more as are wanted
            more = min(length, depth - length)
            ranks[length + more] = self._pair(ranks[length], more)
            length += more
        self.order = np.argsort(ranks[depth], kind="stable")
        self.previous = symbols[self.order - 1]  # the Burrows-Wheeler transform
        self.wavelet = WaveletMatrix(self.previous.astype(np.int64), self.alphabet)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=self.alphabet))))
        self.common = self._common(ranks, n)
        self._bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _pair(rank: np.ndarray, shift: int) -> np.ndarray:
        after = np.zeros_like(rank)
        after[: len(rank) - shift] = rank[shift:] + 1
        return np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)[1]

    def _common(self, ranks: dict[int, np.ndarray], n: int) -> np.ndarray:
        """How many first words each suffix shares with the one before it, up to depth."""
        a, b = self.order[:-1], self.order[1:]
        shared = np.zeros(len(b), np.int64)
        if len(b):
            shared[ranks[self.depth][a] == ranks[self.depth][b]] = self.depth
            for length in sorted((k for k in ranks if k < self.depth), reverse=True):
                todo = (shared + length <= self.depth) & (a + shared < n) & (b + shared < n)
                i = np.flatnonzero(todo)
                i = i[ranks[length][a[i] + shared[i]] == ranks[length][b[i] + shared[i]]]
                shared[i] += length
        return np.concatenate(([0], shared)).astype(np.int8 if self.depth < 128 else np.int32)

    def bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place in suffix order, the interval of suffixes with the same first words."""
        if depth not in self._bounds:
            new = self.common < depth
            new[0] = True
            firsts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            self._bounds[depth] = firsts[group], np.append(firsts[1:], len(new))[group]
        return self._bounds[depth]

    def extend(self, c: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more word c in front; empty where there are none."""
        a, b = self.wavelet.ranks(c, left, right)
        return self.smaller[c] + a, self.smaller[c] + b

    def matching_statistics(self, patterns: np.ndarray, lengths: np.ndarray):
        """Backward search of many patterns side by side, from their last word to their first.

        patterns: one row each, words from its first column on; words unknown to
        the index are -1.  Yields (rows, position, matched, left) for each step:
        how many words from the position on occur in the index, up to depth,
        and the first place of their interval.
        """
        rows = np.flatnonzero(lengths > 0)
        left, right = np.zeros(len(lengths), np.int64), np.full(len(lengths), len(self.order), np.int64)
        matched = np.zeros(len(lengths), np.int64)
        done = 0
        while len(rows):
            position = lengths[rows] - 1 - done
            full = rows[matched[rows] == self.depth]
            self._shorten(full, self.depth - 1, matched, left, right)
            trying, c = rows, patterns[rows, position]
            unknown = c < 0
            gone = trying[unknown]
            matched[gone], left[gone], right[gone] = 0, 0, len(self.order)
            trying, c = trying[~unknown], c[~unknown]
            while len(trying):
                a, b = self.extend(c, left[trying], right[trying])
                found = a < b
                hit = trying[found]
                left[hit], right[hit] = a[found], b[found]
                matched[hit] += 1
                trying, c = trying[~found], c[~found]
                none = matched[trying] == 0  # the word itself does not occur
                trying, c = trying[~none], c[~none]
                for depth in np.unique(matched[trying]).tolist():
                    self._shorten(trying[matched[trying] == depth], depth - 1, matched, left, right)
            yield rows, position, matched[rows], left[rows]
            done += 1
            rows = rows[lengths[rows] > done]

    def _shorten(self, rows: np.ndarray, depth: int, matched: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        if not len(rows):
            return
        if depth == 0:
            left[rows], right[rows] = 0, len(self.order)
        else:
            first, last = self.bounds(depth)
            at = left[rows]
            left[rows], right[rows] = first[at], last[at]
        matched[rows] = depth
