"""Decoding to the E8 lattice (all integers with even sum, or all half-integers with even sum)."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np


def shortest_vectors() -> np.ndarray:
    """The 240 lattice vectors of squared length 2: the neighbouring cells of any cell."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with even sum: an odd sum is mended where
    rounding was least certain."""
    p = np.rint(x)
    odd = np.flatnonzero(p.sum(axis=1) % 2 != 0)
    off = x[odd] - p[odd]
    at = np.abs(off).argmax(axis=1)
    rows = np.arange(len(odd))
    p[odd, at] += np.where(off[rows, at] >= 0, 1.0, -1.0)
    return p


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row of ``x`` (n, 8)."""
    whole, half = nearest_even(x), nearest_even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def neighbours(x: np.ndarray, p: np.ndarray, count: int, shell: np.ndarray) -> np.ndarray:
    """The ``count`` lattice neighbours of each ``p`` that are nearest to ``x``: (n, count, 8)."""
    toward = (x - p) @ shell.T
    best = np.argpartition(-toward, count - 1, axis=1)[:, :count]
    return p[:, None, :] + shell[best]
