"""Suffix-array dedup: sparse suffix arrays over minimiser positions.

A shard keeps only the suffixes that start at a minimiser. They are sorted, neighbours are compared, and each match is
extended to the right by the common prefixes of neighbours and to the left by those of the reversed words before the
minimiser. A window that starts ``offset`` words before its minimiser equals another one when the left extensions agree
over ``offset`` words and the right ones over the rest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Shard, earlier, remove_repeats
from .words import sequence_codes, sequence_sums, window_minima

WINDOW, GRAM = 50, 8


def laid_out(symbols: np.ndarray, at: np.ndarray, step: int, width: int, edge: np.ndarray) -> np.ndarray:
    """Rows of ``width`` symbols from each place on in direction ``step``; 0 beyond the segment's edge."""
    places = at[:, None] + step * np.arange(width)[None, :]
    inside = (places - edge[:, None]) * step < 0
    return np.where(inside, symbols[np.where(inside, places, 0)], 0)


def sorted_with_common(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): sorted rows and the length of the common prefix of each with the one before."""
    order = np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))
    equal = rows[order[1:]] == rows[order[:-1]]
    return order, np.append(0, np.cumprod(equal, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64))


def numbered(order: np.ndarray, common: np.ndarray, reach: int) -> np.ndarray:
    """A number for each row; equal numbers where ``reach`` symbols agree."""
    number = np.empty(len(order), np.int64)
    fresh = common < reach
    number[order] = np.cumsum(fresh)
    return number


def anchors(shard: Shard, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the minimisers of all windows of a shard, and the segment of each."""
    own = np.repeat(np.arange(len(shard.docs)), np.diff(shard.bounds))
    n = len(shard.codes)
    grams = sequence_codes(sequence_sums(shard.codes), np.arange(n - gram + 1), gram)
    _, spot = window_minima(grams, length - gram + 1)
    places = np.unique(spot[own[: len(spot)] == own[length - 1 :][: len(spot)]])
    return places, own[places]


def repeated_windows(shard: Shard, length: int, gram: int) -> np.ndarray:
    """Whether the window starting at each word starts earlier elsewhere in the shard, by the sparse suffix array."""
    repeat = np.zeros(len(shard.codes), bool)
    at, own = anchors(shard, length, gram)
    if not len(at):
        return repeat
    _, docs, places = shard.places()
    symbols = np.unique(shard.codes, return_inverse=True)[1] + 1
    low, high = shard.bounds[own], shard.bounds[own + 1]
    right = sorted_with_common(laid_out(symbols, at, 1, length, high))
    left = sorted_with_common(laid_out(symbols, at - 1, -1, length - gram, low - 1))
    for offset in range(length - gram + 1):
        fits = np.flatnonzero((at - low >= offset) & (high - at >= length - offset))
        if len(fits):
            group = numbered(*right, length - offset)[fits] * (len(at) + 1) + numbered(*left, offset)[fits]
            begin = at[fits] - offset
            repeat[begin] |= earlier(group, docs[begin], places[begin])
    return repeat


def suffix_array_dedup(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the kept words joined by one space).

    A word is removed if it lies in a passage of at least ``window`` words that starts earlier in the corpus: the first
    occurrence stays. Edge cases are those of :func:`tabulon.llm.fm_index.substring_dedup`.
    """
    return remove_repeats(documents, lambda shard: repeated_windows(shard, window, gram), window, gram)
