"""Fast similarity sketching of sets of 64-bit elements, for many sets at once.

Round i < t throws every element into a hashed one of t bins with the value i + hash in [i, i + 1);
round t + j throws all elements into bin j. A bin keeps its smallest value, so bins filled in an early round are
final and a set is done when all of its bins are full: after about ln(t) * t / n rounds, and never more than 2 t.
The share of equal coordinates of two sketches estimates the Jaccard similarity, with concentration as of t
independent samples.
"""

from __future__ import annotations

import numpy as np

from hearthline.llm.words import M3, U, mix

EMPTY = U(0xFFFFFFFFFFFFFFFF)


def sketches(elements: np.ndarray, owner: np.ndarray, sets: int, t: int) -> np.ndarray:
    """A (sets, t) array; ``owner`` says which set each element is of, and a set without elements keeps EMPTY.

    A coordinate holds the hash that won the bin, mixed with its round, so equal coordinates mean equal element and round.
    """
    out = np.full(sets * t, EMPTY, np.uint64)
    base = owner * t
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(elements):
                break
            h = mix(elements ^ (U(i + 1) * M3))
            if i < t:
                at = base + ((h >> U(40)) * U(t) >> U(24)).astype(np.int64)
            else:
                at = base + (i - t)
            free = np.flatnonzero(out[at] == EMPTY)
            at, h = at[free], h[free]
            won = np.full(len(out), EMPTY, np.uint64) if len(at) > len(out) // 8 else None
            if won is None:
                bins, at = np.unique(at, return_inverse=True)
                won = np.full(len(bins), EMPTY, np.uint64)
                np.minimum.at(won, at, h << U(24) | h >> U(40))
                out[bins] = mix(won + U(i))
            else:
                np.minimum.at(won, at, h << U(24) | h >> U(40))
                bins = np.flatnonzero(won != EMPTY)
                out[bins] = mix(won[bins] + U(i))
            if i >= 4 or i % 2:
                open_sets = (out.reshape(sets, t) == EMPTY).any(axis=1)
                keep = open_sets[owner]
                elements, owner, base = elements[keep], owner[keep], base[keep]
    return out.reshape(sets, t)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates; the band's number is part of the key."""
    sets, t = sketch.shape
    bands = t // rows
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * M3), (sets, bands)).copy()
        for r in range(rows):
            key = mix(key * M3 + sketch[:, r : bands * rows : rows])
    return key
