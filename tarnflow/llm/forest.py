"""Groups of linked rows on arrays: ``heads[i]`` is a row of the same group, the smallest once settled."""

from __future__ import annotations

import numpy as np


def merge(heads: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Union of x[i] with y[i] for all i; smaller rows become heads."""
    while len(x):
        x, y = root(heads, x), root(heads, y)
        differ = x != y
        if not differ.any():
            return
        x, y = x[differ], y[differ]
        np.minimum.at(heads, np.maximum(x, y), np.minimum(x, y))


def root(heads: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = heads[x]
        if (up == x).all():
            return x
        heads[x] = heads[up]
        x = up


def settle(heads: np.ndarray) -> np.ndarray:
    while True:
        up = heads[heads]
        if (up == heads).all():
            return heads
        heads = up
