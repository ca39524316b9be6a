"""Gear rolling hash and content-defined cut points over arrays of code points."""

from __future__ import annotations

import numpy as np

WINDOW = 16  # code points that a hash depends on: 32 bits, two of them shifted out at each step

#: One pseudo-random word for each value of the low 16 bits of a code point.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


def gear_hashes(points: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[points[i - j]] << 2j for j < WINDOW, by doubling; the first WINDOW - 1 lack context."""
    h = GEAR[points & 0xFFFF]
    reach = 1
    while reach < WINDOW:
        longer = h.copy()
        longer[reach:] += h[:-reach] << np.uint32(2 * reach)
        h, reach = longer, reach * 2
    return h


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for every full window."""
    n, out, have = len(values), values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out[: n - width + 1]


def landmarks(points: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Cut points of each text: every position whose hash is the smallest of some `window` successive ones of its text
    (each of the smallest, where hashes are equal). Any `window` successive positions contain one, and whether a
    position is one depends only on the WINDOW + 2 * window code points around it.
    """
    n = len(points)
    if n < window:
        return np.empty(0, np.int64)
    h = gear_hashes(points)
    low = _sliding_min(h, window)
    inside = np.ones(len(low), bool)  # windows that lie in one text, past the positions that lack context
    bad_from = np.maximum(starts[:-1] - window + 1, 0)
    bad_to = np.minimum(starts[:-1] + WINDOW - 1, len(low))
    edges = np.zeros(len(low) + 1, np.int32)
    np.add.at(edges, np.minimum(bad_from, len(low)), 1)
    np.add.at(edges, np.maximum(bad_to, np.minimum(bad_from, len(low))), -1)
    inside = np.cumsum(edges[:-1]) == 0
    # a position i is a cut if a valid window start j in (i - window, i] has low[j] == h[i], that is, if the
    # largest of the valid lows that cover it reaches its hash
    reach = np.where(inside, low.astype(np.int64), -1)
    padded = np.concatenate([np.full(window - 1, -1), reach, np.full(window - 1, -1)])
    top = -_sliding_min(-padded, window)
    return np.flatnonzero(top[:n] == h.astype(np.int64))
