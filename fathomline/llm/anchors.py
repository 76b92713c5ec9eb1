"""Content-chosen anchors: every window of a byte string names the place of its least gram, wherever the window stands.

Equal windows have the same anchor gram at the same offset, so all occurrences of a repeated string meet under the hash
of that gram. Consecutive windows with one anchor make one context.
"""

from __future__ import annotations

import numpy as np

GRAM = 64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte substrings, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    size, factor = 1, 0xD6E8FEB86659FD93
    while size < GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        h ^= h >> np.uint64(29)
        size, factor = 2 * size, (factor * 0xFF51AFD7ED558CCD + 2 * size) % (1 << 64) | 1
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    low, size = values, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(values) - width + 1], low[width - size : width - size + len(values) - width + 1])


def contexts(data: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """For each context of a byte string: first and last window start, anchor place, and hash of the anchor gram."""
    if len(data) < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    hashes = gram_hashes(data)
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    place = (window_least(ranked, window - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return first, np.append(first[1:], len(place)) - 1, place[first], hashes[place[first]]


def sub_contexts(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A context cut further by the least gram but its anchor: first and last window start, and hash of that gram.

    All windows of a context have the same anchor; equal windows also have the same second gram at the same offset.
    """
    hashes = gram_hashes(data)
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    anchor = int(window_least(ranked, window - GRAM + 1)[0] & np.uint64(0xFFFFFFFF))
    ranked[anchor] |= np.uint64(0xFFFFFFFF00000000)
    place = (window_least(ranked, window - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return first, np.append(first[1:], len(place)) - 1, hashes[place[first]]
