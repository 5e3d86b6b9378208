"""Quadtrees over sparse count matrices: which quadrants hold anything, as one bitmap for each level.

A tree covers ``side`` x ``side`` cells (a power of two). Every node that isn't empty has four bits in the bitmap of the
next level, one for each quarter (upper left, upper right, lower left, lower right); the counts of the single cells follow
in the order of the last bitmap. Empty quarters have no nodes below them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class QuadTree:
    """``levels[l]`` has four bits for every node of level l; ``counts`` belong to the set bits of the last one."""

    levels: list[np.ndarray]
    counts: np.ndarray

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, side: int) -> QuadTree:
        """A tree of distinct cells with nonzero counts."""
        depth = side.bit_length() - 1
        place = np.zeros(len(rows), np.int64)
        for bit in range(depth - 1, -1, -1):
            place = place << 2 | ((rows >> bit) & 1) << 1 | ((columns >> bit) & 1)
        order = np.argsort(place)
        place, levels, nodes = place[order], [], np.zeros(min(1, len(rows)), np.int64)
        for level in range(1, depth + 1):
            below = np.unique(place >> 2 * (depth - level))
            bits = np.zeros(4 * len(nodes), bool)
            bits[4 * np.searchsorted(nodes, below >> 2) + (below & 3)] = True
            levels.append(bits)
            nodes = below
        return cls(levels, np.asarray(counts, np.int64)[order])

    def to_bytes(self) -> tuple[bytes, bytes]:
        """(bitmaps one after another, counts)."""
        bits = np.concatenate(self.levels) if self.levels else np.zeros(0, bool)
        return np.packbits(bits).tobytes(), self.counts.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, bitmaps: bytes, counts: bytes, side: int) -> QuadTree:
        bits, held = np.unpackbits(np.frombuffer(bitmaps, np.uint8)).astype(bool), np.frombuffer(counts, "<i8")
        levels, nodes, at = [], min(1, len(held)), 0
        for _ in range(side.bit_length() - 1):
            levels.append(bits[at : at + 4 * nodes])
            at += 4 * nodes
            nodes = int(levels[-1].sum())
        return cls(levels, held)

    @classmethod
    def empty(cls, side: int) -> QuadTree:
        return cls([np.zeros(0, bool)] * (side.bit_length() - 1), np.zeros(0, np.int64))

    def children(self) -> list[np.ndarray]:
        """For every bit of every level, the number of its node on the next level, -1 if the quarter is empty."""
        return [np.where(bits, np.cumsum(bits) - 1, -1) for bits in self.levels]

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, columns, counts) of all cells that hold something."""
        rows = columns = np.zeros(min(1, len(self.counts)), np.int64)
        for bits in self.levels:
            at = np.flatnonzero(bits)
            rows, columns = rows[at >> 2] << 1 | (at >> 1 & 1), columns[at >> 2] << 1 | (at & 1)
        return rows, columns, self.counts


def joint_cells(a: QuadTree, b: QuadTree, n_a: int, n_b: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, count in a, count in b) wherever either holds something in a column they share.

    Both trees are walked down together, one quarter of the columns at a time: a pair of nodes of which neither holds
    anything ends its walk, so nothing below is visited. Only the first ``n_a`` and ``n_b`` rows count; with ``same``
    (a tree with itself) each pair of rows is met once, the smaller first.
    """
    up_a, up_b, depth = a.children(), b.children(), len(a.levels)
    node_a, node_b = (np.full(1, 0 if len(t.counts) else -1) for t in (a, b))
    row_a, row_b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    quarters = [np.repeat([0, 1], 4), np.tile(np.repeat([0, 1], 2), 2), np.tile([0, 1], 4)]
    if node_a[0] < 0 and node_b[0] < 0:
        return (np.zeros(0, np.int64),) * 4
    for level in range(depth):
        n = len(row_a)
        half_a, half_b, half_c = (np.tile(q, n) for q in quarters)
        next_a, next_b = np.repeat(row_a, 8) << 1 | half_a, np.repeat(row_b, 8) << 1 | half_b
        left = depth - level - 1
        fits = (next_a << left < n_a) & (next_b << left < n_b)
        if same:
            fits &= next_a <= next_b if left else next_a < next_b

        def below(nodes: np.ndarray, table: np.ndarray, half: np.ndarray) -> np.ndarray:
            nodes = np.repeat(nodes, 8)
            held = nodes >= 0
            out = np.full(len(nodes), -1)
            out[held] = table[4 * nodes[held] + 2 * half[held] + half_c[held]]
            return out

        to_a, to_b = below(node_a, up_a[level], half_a), below(node_b, up_b[level], half_b)
        fits &= (to_a >= 0) | (to_b >= 0)
        node_a, node_b, row_a, row_b = to_a[fits], to_b[fits], next_a[fits], next_b[fits]
    count_a, count_b = (np.where(node >= 0, np.append(t.counts, 0)[node], 0) for node, t in ((node_a, a), (node_b, b)))
    return row_a, row_b, count_a, count_b
