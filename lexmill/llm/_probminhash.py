"""ProbMinHash signatures, computed for many weighted sets at once."""

from __future__ import annotations

import numpy as np

from ._shingles import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)
_U53 = 1.0 / (1 << 53)


def signatures(keys: np.ndarray, weights: np.ndarray, sets: np.ndarray, n_sets: int, m: int) -> np.ndarray:
    """Registers of each set: an (n_sets, m) array of element hashes.

    Each element sends a Poisson process of arrivals at a rate equal to its weight; every arrival falls
    on a random register, and a register keeps the element of its earliest arrival. Arrivals are drawn
    round by round for all sets together. An element stops as soon as its next arrival would come after
    the latest register of its set (no register can change any more), so nearly all of them stop after
    one or two rounds. Two sets agree in a register with the probability Jaccard similarity.
    """
    first = np.full(n_sets * m, np.inf)
    held = np.zeros(n_sets * m, np.uint64)
    state, base = keys.copy(), sets.astype(np.int64) * m
    elem, w, at = keys, weights.astype(float), np.zeros(len(keys))
    owner = sets
    while len(elem):
        state = state + _STEP
        draw = mix(state)
        at = at - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * _U53) / w
        slot = base + (mix(draw ^ _STEP) % np.uint64(m)).astype(np.int64)
        live = at < first[slot]
        s, t = slot[live], at[live]
        np.minimum.at(first, s, t)
        won = first[s] == t
        held[s[won]] = elem[live][won]
        latest = first.reshape(n_sets, m).max(axis=1)
        go = at < latest[owner]
        state, base, elem, w, at, owner = state[go], base[go], elem[go], w[go], at[go], owner[go]
    return held.reshape(n_sets, m)


def band_hashes(registers: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash for each band of consecutive registers."""
    n, m = registers.shape
    rows = m // bands
    grid = registers[:, : rows * bands].reshape(n, bands, rows)
    acc = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
    for r in range(rows):
        acc = mix(acc * np.uint64(0x100000001B3) ^ grid[:, :, r])
    return acc.view(np.int64)
