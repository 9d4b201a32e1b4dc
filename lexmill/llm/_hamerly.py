"""Lloyd's rounds over integer parts with Hamerly's two bounds, in numpy."""

from __future__ import annotations

import numpy as np

#: Components within this magnitude, so that squared distances and sums of them stay within 64 bits.
LARGEST = 1 << 28


def up(x: np.ndarray) -> np.ndarray:
    """The next larger float32: at least x, whatever was lost in rounding."""
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(n, k) squared distances of n parts to k entries, exact."""
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1) if len(entries) else np.empty((len(x), 0), np.int64)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each part (the lowest of several), its distance and that of the second-nearest."""
    d = squared(x, entries)
    best = d.argmin(axis=1)
    rows = np.arange(len(x))
    nearest = d[rows, best]
    if d.shape[1] == 1:
        return best, np.sqrt(nearest), np.full(len(x), np.inf)
    d[rows, best] = np.iinfo(np.int64).max
    return best, np.sqrt(nearest), np.sqrt(d.min(axis=1))


class Rounds:
    """Assignments of the parts of one position to its codebook, as entries move.

    A part keeps its entry, an upper bound of the distance to it, and a lower bound of the distance to
    any other. While the upper bound is less than the lower one, the entry is the only nearest, and no
    distance is computed. If not, the upper bound is first made exact, and only if that is still not
    less are all entries scanned. Bounds are float32, rounded outwards, and all distances integers, so no
    tie is missed: at a tie the bounds are not strictly apart, and the scan takes the lower index.
    """

    def __init__(self, entries: np.ndarray, moved: np.ndarray):
        """entries: (k, width); moved: squared distances that the entries have moved since the last round."""
        self.entries = entries
        self.moved = up(np.sqrt(moved.astype(np.float64))).astype(np.float64)
        order = np.argsort(self.moved)
        self.most, self.second = (order[-1], self.moved[order[-2]] if len(order) > 1 else 0.0) if len(order) else (0, 0.0)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, d1, d2 = scan(x, self.entries)
        return code.astype(np.uint8), up(d1), down(d2)

    def next(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The new entries and bounds, and how many parts were scanned."""
        code, mine = code.copy(), code.astype(np.intp)
        upper = up(upper + self.moved[mine])
        lower = down(lower - np.where(mine == self.most, self.second, self.moved[self.most]))
        open_ = np.flatnonzero(~(upper < lower))
        upper[open_] = up(np.sqrt(((x[open_] - self.entries[mine[open_]]) ** 2).sum(axis=1)))
        open_ = open_[~(upper[open_] < lower[open_])]
        if len(open_):
            best, d1, d2 = scan(x[open_], self.entries)
            code[open_], upper[open_], lower[open_] = best, up(d1), down(d2)
        return code, upper, lower, len(open_)
