"""Median cut over a weighted list of colours: the numpy kernel of the palette operator and of the GIF writer."""

from __future__ import annotations

import numpy as np


def median_cut(colors: np.ndarray, weight: np.ndarray, capacity: int) -> np.ndarray:
    """(slots, 3) mean colours, rounded down, of at most ``capacity`` buckets of ``colors`` (n, 3), which are distinct.

    The bucket with the widest channel (of several the first) goes, and its two halves
    follow at the end.  It is cut along that channel (of several r, g, b in this order),
    stably sorted, behind the colour that brings the running weight to half of the
    bucket's, rounded down; neither half is empty.
    """
    buckets, spreads = [np.arange(len(colors))], [_spread(colors)]
    while len(buckets) < capacity and max(s.max() for s in spreads) > 0:
        k = int(np.argmax([s.max() for s in spreads]))
        own, spread = buckets.pop(k), spreads.pop(k)
        own = own[np.argsort(colors[own, int(np.argmax(spread))], kind="stable")]
        running = np.cumsum(weight[own])
        at = int(np.clip(np.searchsorted(running, running[-1] // 2) + 1, 1, len(own) - 1))
        for half in (own[:at], own[at:]):
            buckets.append(half)
            spreads.append(_spread(colors[half]))
    return np.array([(colors[b] * weight[b, None]).sum(axis=0) // weight[b].sum() for b in buckets])


def _spread(colors: np.ndarray) -> np.ndarray:
    """Largest less smallest value of each channel."""
    return colors.max(axis=0) - colors.min(axis=0) if len(colors) else np.zeros(3, np.int64)
