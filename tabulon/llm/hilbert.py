"""Places along a Hilbert curve through a grid of any number of dimensions."""

from __future__ import annotations

import numpy as np


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index of each row of grid cells (whole numbers below ``2**bits``) along the curve; ``columns * bits`` may reach 62.

    Skilling's construction (2004): the cells' bit planes are undone to Gray code from the highest plane down, then the
    planes are interleaved. Neighbours on the curve are neighbours in the grid.
    """
    x = np.array(cells, dtype=np.int64)
    n = x.shape[1]
    top = np.int64(1) << (bits - 1)
    plane = top
    while plane > 1:
        low = plane - 1
        for i in range(n):
            turned = (x[:, i] & plane) != 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            x[:, i] ^= swap
        plane >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip, plane = np.zeros(len(x), np.int64), top
    while plane > 1:
        flip ^= np.where(x[:, n - 1] & plane, plane - 1, 0)
        plane >>= 1
    x ^= flip[:, None]
    index = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[:, i] >> bit) & 1)
    return index
