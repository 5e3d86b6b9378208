"""Simple-8b: a 64-bit word holds a 4-bit selector and as many ids as fit at that selector's width.

Ids of 59 bits or more are escaped: a mark (selector 15, bit 59 set) says how many ids follow, each in a whole word.
Everything but one short step per written word is array work.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Fixed values of Simple-8b: ids per word and bits per id by selector (0 and 1 are runs of zeros).
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
PLAIN_BITS = 59
ESCAPE = U((15 << 60) | (1 << 59))
#: Ids in a segment; each segment of a block is packed on its own and can be read on its own.
SEGMENT = 1 << 16


#: Number of bits of every 16-bit value.
BITS16 = np.zeros(1 << 16, np.uint8)
for _bit in range(16):
    BITS16[1 << _bit : 2 << _bit] = _bit + 1


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    if not len(ids) or int(ids.max()) < 1 << 16:
        return BITS16[ids]
    bits, rest = np.zeros(len(ids), np.uint8), ids.copy()
    for step in (32, 16):
        big = rest >= U(1 << step)
        bits[big] += step
        rest[big] >>= U(step)
    return bits + BITS16[rest]


def run_maxima(values: np.ndarray, counts: list[int]) -> dict[int, np.ndarray]:
    """For each count, the maximum of that many values from each place on (places too near the end are missing)."""
    spans, out = {1: values}, {}
    span = 1
    while 2 * span <= min(max(counts), len(values)):
        spans[2 * span] = np.maximum(spans[span][:-span], spans[span][span:])
        span *= 2
    for count in counts:
        if count <= len(values):
            half = 1 << (count.bit_length() - 1)
            low = spans[half]
            out[count] = np.maximum(low[: len(values) - count + 1], low[count - half : count - half + len(values) - count + 1])
    return out


def pack_plain(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    best = np.full(len(ids), 15, np.int8)
    maxima = run_maxima(bits, COUNTS.tolist())
    for selector in range(14, -1, -1):
        most = maxima.get(int(COUNTS[selector]))
        if most is None or most.min() > WIDTHS[selector]:  # a longer run has no smaller maximum
            break
        np.copyto(best[: len(most)], selector, where=most <= WIDTHS[selector])
    jump, places, at = COUNTS[best].tolist(), [], 0
    while at < len(ids):
        places.append(at)
        at += jump[at]
    places = np.array(places, np.int64)
    selectors, ids = best[places], ids.astype(U)
    words = selectors.astype(U) << U(60)
    for selector in np.unique(selectors):
        rows, width = np.flatnonzero(selectors == selector), int(WIDTHS[selector])
        for j in range(int(COUNTS[selector]) if width else 0):
            words[rows] |= ids[places[rows] + j] << U(j * width)
    return words


def pack(ids: np.ndarray) -> np.ndarray:
    """Words of ids from 0 to 2**64 - 1, all in one segment."""
    ids = np.asarray(ids)
    bits = bit_lengths(ids)
    wide = bits > PLAIN_BITS
    if not wide.any():
        return pack_plain(ids, bits) if len(ids) else np.zeros(0, U)
    ids, parts = ids.astype(U), []
    for run in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(wide)) + 1):
        if len(run) and wide[run[0]]:
            parts += [np.array([ESCAPE | U(len(run))], U), ids[run]]
        elif len(run):
            parts.append(pack_plain(ids[run], bits[run]))
    return np.concatenate(parts)


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of a whole number of segments."""
    words = np.asarray(words, U)
    marks = np.flatnonzero(words >= ESCAPE)
    parts, at = [], 0
    while at < len(words):
        k = int(np.searchsorted(marks, at))  # an escaped id may look like a mark, but lies before `at` by then
        ahead = int(marks[k]) if k < len(marks) else len(words)
        parts.append(unpack_plain(words[at:ahead]))
        if ahead < len(words):
            run = int(words[ahead] & ~ESCAPE)
            parts.append(words[ahead + 1 : ahead + 1 + run])
            ahead += 1 + run
        at = ahead
    return np.concatenate(parts) if parts else np.zeros(0, U)


def unpack_plain(words: np.ndarray) -> np.ndarray:
    selectors = (words >> U(60)).astype(np.int8)
    ends = np.cumsum(COUNTS[selectors])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, U)
    starts = ends - COUNTS[selectors]
    for selector in np.unique(selectors):
        rows, width = np.flatnonzero(selectors == selector), int(WIDTHS[selector])
        for j in range(int(COUNTS[selector]) if width else 0):
            out[starts[rows] + j] = (words[rows] >> U(j * width)) & U((1 << width) - 1)
    return out


def pack_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): the words of all segments and the first word of each segment."""
    parts = [pack(ids[at : at + SEGMENT]) for at in range(0, len(ids), SEGMENT)]
    offsets = np.cumsum([0, *map(len, parts)])[:-1].astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, U)), (offsets if parts else np.zeros(0, np.int64))


def read_ids(words: np.ndarray, offsets: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a block, decoding only the segments that hold them."""
    first, last = start // SEGMENT, -(-stop // SEGMENT)
    end = int(offsets[last]) if last < len(offsets) else len(words)
    ids = unpack(words[int(offsets[first]) : end]) if start < stop else np.zeros(0, U)
    return ids[start - first * SEGMENT : stop - first * SEGMENT]
