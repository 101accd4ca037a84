"""A compressed FM-index of a sequence of words, with matching statistics up to a fixed length.

Suffixes are sorted by their first ``depth`` words, which is all that a search for so many words needs.
The Burrows-Wheeler transform is held as a wavelet matrix, the level-wise form of a wavelet tree: one bit
vector a level with a count every 64 bits.  Backward search runs for many patterns side by side: in every
step each of them takes one word more or, where that does not occur, gives up words at its far end by going
to the parent interval.  Of the suffix array one place is kept for each interval of ``depth`` words, the first.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank over a sequence of small integers."""

    def __init__(self, values: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        n = len(values)
        for level in range(self.levels - 1, -1, -1):
            ones = (values >> level) & 1 == 1
            packed = np.packbits(ones, bitorder="little")
            padded = np.zeros((n // 64 + 1) * 8, np.uint8)
            padded[: len(packed)] = packed
            words = padded.view("<u8")
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:], dtype=np.int32)
            self.words.append(words)
            self.counts.append(before)
            self.zeros.append(n - int(ones.sum()))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, value: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often ``value`` is among the first ``upto``, less where it begins in the last level."""
        at = upto.astype(np.int64)
        for k in range(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & below).astype(np.int64)
            at = np.where((value >> (self.levels - 1 - k)) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at


def _ranks(words: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """For each length, the rank of every place by so many words from there on; each length is at most twice the one before."""
    out = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    for before, length in zip(lengths, lengths[1:], strict=False):
        now = out[-1]
        ahead = np.zeros(len(now), np.int64)
        step = length - before
        ahead[: len(now) - step] = now[step:] + 1
        out.append(np.unique(now * (len(now) + 1) + ahead, return_inverse=True)[1].astype(np.int64))
    return out


class FMIndex:
    """Index of ``words``, in which 0 ends each text and is in no pattern."""

    def __init__(self, words: np.ndarray, depth: int):
        n = len(words)
        self.n, self.depth = n, depth
        lengths = [1]
        while lengths[-1] < depth:
            lengths.append(min(2 * lengths[-1], depth))
        ranks = _ranks(words, lengths)
        order = np.argsort(ranks[-1], kind="stable")
        size = int(words.max()) + 1
        transform = words[order - 1]
        self.matrix = WaveletMatrix(transform, size)
        starts = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=size))])
        # Rank is counted from where a word begins in the last level.
        every = np.arange(size)
        self.shift = starts[:-1] - self.matrix.rank(every, np.zeros(size, np.int64))
        self.common = self._common(ranks, lengths, order)
        self._parents()
        groups = np.nonzero(self.common[:-1] < depth)[0]
        #: The first place of the texts in each interval of ``depth`` words, and the interval of every row.
        self.first = np.minimum.reduceat(order, groups)
        self.group = (np.cumsum(self.common[:-1] < depth) - 1).astype(np.int32)
        self.shorter = self._bounds(depth - 1)

    def _common(self, ranks: list[np.ndarray], lengths: list[int], order: np.ndarray) -> np.ndarray:
        """Words that neighbouring rows have in common, ``depth`` at most; -1 before the first row and after the last."""
        n, out = self.n, np.zeros(self.n + 1, np.int16)
        a, b, same = order[:-1].copy(), order[1:].copy(), np.zeros(max(n - 1, 0), np.int64)
        whole = ranks[-1][order[:-1]] == ranks[-1][order[1:]] if n > 1 else np.zeros(0, bool)
        for rank, length in zip(ranks[-2::-1] if len(ranks) > 1 else [], lengths[-2::-1], strict=True):
            inside = (a < n) & (b < n)
            equal = np.zeros(len(a), bool)
            equal[inside] = rank[a[inside]] == rank[b[inside]]
            # A shorter text ends in nothing, which its rank tells apart from a word.
            equal &= ~whole
            a, b, same = a + length * equal, b + length * equal, same + length * equal
        out[1:-1] = np.where(whole, self.depth, np.minimum(same, self.depth - 1))
        out[0] = out[-1] = -1
        return out

    def _parents(self) -> None:
        """For every row, the nearest ones above and below that have fewer words in common with the row before."""
        n, places = self.n, np.arange(self.n + 1)
        self.above, self.below = np.zeros(n + 1, np.int32), np.full(n + 1, n, np.int32)
        for v in range(1, self.depth + 1):
            here = np.nonzero(self.common == v)[0]
            if len(here):
                fewer = places[self.common < v]
                at = np.searchsorted(fewer, here)
                self.above[here], self.below[here] = fewer[at - 1], fewer[at]

    def _bounds(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For every row, the interval of rows that begin with the same ``length`` words."""
        edges = np.nonzero(self.common < length)[0]
        of = np.cumsum(self.common[:-1] < length) - 1
        return edges[of].astype(np.int32), edges[of + 1].astype(np.int32)

    def matching_statistics(self, patterns: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every place of the concatenated ``patterns``: how many words from there on, up to ``depth`` and
        the pattern's end, occur in the texts, and where ``depth`` do, the first place; else -1.  Words that
        the texts lack are given as -1 or as 0."""
        lengths, places = np.zeros(len(patterns), np.int16), np.full(len(patterns), -1, np.int64)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        at = ends.astype(np.int64) - 1  # the place that is taken next
        low, high, have = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64), np.zeros(len(ends), np.int64)
        live = np.nonzero(at >= begins)[0]
        while len(live):
            i, l, h, q = at[live], low[live], high[live], have[live]
            word = patterns[i]
            full = q == self.depth
            l, h, q = np.where(full, self.shorter[0][np.minimum(l, self.n - 1)], l), np.where(full, self.shorter[1][np.minimum(l, self.n - 1)], h), q - full
            known = (word > 0) & (word < len(self.shift))
            safe = np.where(known, word, 1 if len(self.shift) > 1 else 0)
            both = self.matrix.rank(np.concatenate([safe, safe]), np.concatenate([l, h]))
            nl, nh = both[: len(l)] + self.shift[safe], both[len(l) :] + self.shift[safe]
            grown = known & (nl < nh)
            # A word that does not even occur alone ends every match; other failures go to the parent.
            lost = ~grown & ((q == 0) | ~known)
            wide = ~grown & ~lost
            row = np.where(self.common[l] >= self.common[h], l, h)
            fewer = np.maximum(self.common[row], 0)
            root = fewer == 0
            low[live] = np.where(grown, nl, np.where(wide & ~root, self.above[row], 0))
            high[live] = np.where(grown, nh, np.where(wide & ~root, self.below[row], self.n))
            have[live] = np.where(grown, q + 1, np.where(wide, fewer, 0))
            taken = grown | lost
            lengths[i[grown]] = (q + 1)[grown]
            reached = grown & (q + 1 == self.depth)
            places[i[reached]] = self.first[self.group[nl[reached]]]
            at[live] -= taken
            live = live[at[live] >= begins[live]]
        return lengths, places
