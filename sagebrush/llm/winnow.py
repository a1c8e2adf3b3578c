"""Winnowing: which positions hold the smallest hash of some window."""

from __future__ import annotations

import numpy as np


def minima(hashes: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Flags of the positions that hold the minimum of some window of ``w``
    consecutive hashes; ``valid[j]``: the window that starts at j counts.  Every
    position with the minimum is taken, so ties cannot shift an alignment."""
    n = len(hashes)
    if not n:
        return np.zeros(0, bool)
    lowest = hashes.copy()
    for j in range(1, min(w, n)):
        np.minimum(lowest[: n - j], hashes[j:], out=lowest[: n - j])
    lowest[~valid] = 0
    highest = lowest.copy()  # of the windows that a position lies in
    for j in range(1, min(w, n)):
        np.maximum(highest[j:], lowest[: n - j], out=highest[j:])
    return highest == hashes
