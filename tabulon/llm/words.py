"""Vectorised words and word fingerprints of whole texts.

Every word gets a 64-bit fingerprint, a polynomial over random byte codes; sequences of words get a polynomial over word
fingerprints. Equal sequences have equal fingerprints whatever their place, so both are found with prefix sums and no
loop over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .tables import text_buffers, worker_state

U = np.uint64
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so that each power has an inverse
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything but 0-9, a-z and bytes of non-ASCII letters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[48:58] = PUNCTUATION[97:123] = PUNCTUATION[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


CODES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64; the last size asked for is remembered."""
    state, name = worker_state(), f"powers {base}"
    if name in state and len(state[name][0]) >= size:
        return state[name]
    up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
    up[0] = down[0] = 1
    state[name] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return state[name]


def power_size(n: int) -> int:
    return 1 << max(16, int(n + 1).bit_length())


@dataclass
class Words:
    """Words of several texts, one after another; ``bounds[d]:bounds[d + 1]`` are the words of text d."""

    codes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words_of(texts: pa.Array, lower: bool = False, separators: np.ndarray = SPACE) -> Words:
    data, offsets = text_buffers(texts)
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    bounds = np.searchsorted(starts, offsets)
    up, down = powers(BYTE_BASE, power_size(len(data)))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(CODES[data] * up[: len(data)], out=sums[1:])
    return Words(mix((sums[ends] - sums[starts]) * down[starts]), bounds, starts, ends, data)


def sequence_sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`sequence_codes` takes the fingerprint of any run of words."""
    up, _ = powers(WORD_BASE, power_size(len(codes)))
    sums = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return sums


def sequence_codes(sums: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    _, down = powers(WORD_BASE, power_size(len(sums) - 1))
    return mix((sums[starts + lengths] - sums[starts]) * down[starts] + U(1))


def shingle_codes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, fingerprint) of every run of ``size`` words; a text of fewer words has its whole sequence as one."""
    counts = words.counts
    sums = sequence_sums(words.codes)
    each = np.where(counts == 0, 0, np.maximum(1, counts - size + 1))
    owner = np.repeat(np.arange(len(counts)), each)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each) + words.bounds[owner]
    return owner, sequence_codes(sums, begin, np.minimum(size, counts)[owner])


def window_minima(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(minimum, its first place) of each run of ``width`` values, by doubling."""
    def least(gap: int) -> tuple[np.ndarray, np.ndarray]:
        right = low[gap:] < low[: len(low) - gap]
        return np.where(right, low[gap:], low[: len(low) - gap]), np.where(right, place[gap:], place[: len(low) - gap])

    span, low, place = 1, values, np.arange(len(values))
    while 2 * span <= width:
        low, place = least(span)
        span *= 2
    return least(width - span) if width > span else (low, place)
