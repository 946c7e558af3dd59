"""Fast similarity sketching (Dahlgaard, Knudsen and Thorup, 2017) in numpy, for many sets at once.

A sketch of t coordinates is filled in rounds. In round i < t every element of a set falls into a random bin with a
random value; in round t + j every element falls into bin j, so after 2t rounds no coordinate of a non-empty set is empty.
A bin keeps the least (round, value). Two sets agree in a coordinate with probability equal to their Jaccard similarity,
and the number of agreeing coordinates is concentrated as for t independent hash functions. A set is done as soon as all
its bins are full, after about t ln t / n rounds for n elements.
"""

from __future__ import annotations

import numpy as np

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of two multiplications, seeded."""
    h = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sketch(values: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """The (sets, t) sketches of consecutive runs of ``values``; a run of size 0 keeps the empty mark in every bin."""
    sizes = np.asarray(sizes, dtype=np.int64)
    out = np.full((len(sizes), t), _EMPTY, dtype=np.uint64)
    live = np.flatnonzero(sizes)
    elements = np.ascontiguousarray(values).view(np.uint64)
    runs, flat = sizes[live], out.reshape(-1)
    for i in range(2 * t):
        if not len(live):
            break
        h = mix(elements, i)
        # round in the high bits: a bin filled in an earlier round is never replaced
        value = (np.uint64(i) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
        if i < t:
            bins = ((h >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24)
            np.minimum.at(flat, np.repeat(live * t, runs) + bins.astype(np.int64), value)
        else:
            at = live * t + (i - t)
            least = np.minimum.reduceat(value, np.concatenate(([0], np.cumsum(runs)[:-1])))
            flat[at] = np.minimum(flat[at], least)
        if i % 4 == 3 or i >= t:
            open_ = (out[live] == _EMPTY).any(axis=1)
            if not open_.all():
                elements = elements[np.repeat(open_, runs)]
                live, runs = live[open_], runs[open_]
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of consecutive coordinates."""
    keys = np.empty((len(sketches), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(sketches), b + 1, dtype=np.uint64)
        for r in range(rows):
            key = mix(key ^ sketches[:, b * rows + r], 1000 + r)
        keys[:, b] = key
    return keys.view(np.int64)
