"""Substring dedup with an FM-index per shard.

The index of a shard is the Burrows-Wheeler transform of its segments in a wavelet matrix of packed bits. All window ends
walk backwards together: one step narrows the suffix interval of every walk by the word before. A walk ends when its match
occurs nowhere else; the number of its steps is the matching statistic of the place. Walks that reach the threshold report
their window, and the suffix interval tells which windows are equal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Shard, earlier, remove_repeats

WINDOW, GRAM = 20, 6


class Bits:
    """Packed bits with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, depth: int):
        self.depth, self.levels, self.zeros = depth, [], []
        for bit in range(depth - 1, -1, -1):
            ones = (symbols >> bit) & 1 == 1
            self.levels.append(Bits(ones))
            self.zeros.append(int((~ones).sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def ranks(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``low`` and before ``high``."""
        begin = np.zeros_like(low)
        for level, zeros, bit in zip(self.levels, self.zeros, range(self.depth - 1, -1, -1), strict=True):
            one = (symbols >> bit) & 1 == 1
            moved = []
            for at in (begin, low, high):
                ones = level.rank(at)
                moved.append(np.where(one, zeros + ones, at - ones))
            begin, low, high = moved
        return low - begin, high - begin


class FmIndex:
    """Index of a text of symbols from 0; suffixes are sorted by their first ``reach`` symbols, enough for such patterns."""

    def __init__(self, text: np.ndarray, reach: int):
        n = len(text)
        rank, span = np.unique(text, return_inverse=True)[1], 1
        while span < reach:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - span)] = rank[span:] + 1
            rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1]
            span *= 2
        suffixes = np.argsort(rank, kind="stable")
        before = text[suffixes - 1]
        sigma = int(text.max()) + 1 if n else 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.tree = WaveletMatrix(before.astype(np.int64), max(1, (sigma - 1).bit_length()))
        self.n = n

    def back(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of symbol + pattern from those of the patterns."""
        low, high = self.tree.ranks(symbols, low, high)
        return self.first[symbols] + low, self.first[symbols] + high


def matching_statistics(index: FmIndex, text: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, interval): the longest match, up to ``limit``, that ends at each place and occurs twice at least."""
    n = len(text)
    length, interval = np.zeros(n, np.int32), np.full(n, -1)
    ends = np.flatnonzero(text > 0)  # 0 separates segments
    low, high = np.zeros(len(ends), np.int64), np.full(len(ends), index.n)
    for step in range(limit):
        at = ends - step
        alive = at >= 0
        alive[alive] = text[at[alive]] > 0
        ends, low, high = ends[alive], low[alive], high[alive]
        low, high = index.back(text[ends - step], low, high)
        again = high - low > 1
        ends, low, high = ends[again], low[again], high[again]
        length[ends] = step + 1
        interval[ends] = low
    return length, interval


def repeated_windows(shard: Shard, length: int) -> np.ndarray:
    """Whether the window starting at each word starts earlier elsewhere in the shard, by the FM-index."""
    n = len(shard.codes)
    own, docs, places = shard.places()
    text = np.zeros(n + len(shard.docs), np.int64)
    spot = np.arange(n) + own  # one separator after each segment
    text[spot] = np.unique(shard.codes, return_inverse=True)[1] + 1
    found, interval = matching_statistics(FmIndex(text, length), text, length)
    ends = np.flatnonzero(found[spot] >= length)
    repeat = np.zeros(n, bool)
    begins = ends - length + 1
    repeat[begins] = earlier(interval[spot[ends]], docs[begins], places[begins])
    return repeat


def substring_dedup(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the kept words joined by one space).

    Words are runs between ASCII white space. A word is removed if a window of ``window`` words that covers it has the
    same words as a window that starts earlier (smaller doc_id, or the same document and an earlier start); all windows
    are judged on the input. Null and empty texts have no words. Rows with a null id are returned whole and are no
    source of copies; doc_id is taken to identify a text, so repeated rows get equal results; other columns are ignored;
    an empty table gives no rows. Words are compared by 64-bit fingerprints.
    """
    return remove_repeats(documents, lambda shard: repeated_windows(shard, window), window, gram)
