"""Suffix arrays and window anchors over the bytes of one shard, in numpy."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_MULTIPLIER, _MIX = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    out, block = np.ones(n, U64), 1
    while block < n:
        out[block : 2 * block] = out[:block][: n - block] * U64(pow(base, block, 1 << 64))
        block *= 2
    return out


_POWER = _powers(int(_MULTIPLIER), _CHUNK + 4096)
_INVERSE = _powers(pow(int(_MULTIPLIER), -1, 1 << 64), _CHUNK + 4096)
_BYTE = (np.arange(1, 257, dtype=U64) * U64(0xBF58476D1CE4E5B9)) ^ (np.arange(1, 257, dtype=U64) * _MIX >> U64(17))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h *= _MIX
    h ^= h >> U64(29)
    return h


def gram_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit rolling hash of every `size` consecutive bytes (at most _CHUNK + 4096 bytes of text)."""
    sums = np.cumsum(_BYTE[text] * _POWER[: len(text)])
    h = sums[size - 1 :].copy()
    h[1:] -= sums[: len(h) - 1]
    h *= _INVERSE[: len(h)]
    return mixed(h)


def anchors(text: np.ndarray, length: int) -> np.ndarray:
    """For every window of `length` bytes, the smallest hash of the grams of two fifths of its bytes in it.

    It depends on the window's bytes alone, so equal windows have equal anchors, wherever they occur.
    """
    n = len(text) - length + 1
    if n <= 0:
        return np.empty(0, U64)
    size = max(1, 2 * length // 5)
    grams = length - size + 1
    out = np.empty(n, U64)
    for at in range(0, n, _CHUNK):
        m = min(_CHUNK, n - at)
        low, width = gram_hashes(text[at : at + m + length - 1], size), 1
        while width * 2 <= grams:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < grams:
            low = np.minimum(low[: len(low) - (grams - width)], low[grams - width :])
        out[at : at + m] = low
    return out


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as a big-endian number; 72 positions more than text has, which are zeros."""
    w = np.zeros(len(text) + 80, U64)
    w[: len(text)] = text
    for step in (1, 2, 4):
        w[:-step] = (w[:-step] << U64(8 * step)) | w[step:]
    return w[: len(text) + 72]


def suffix_array(text: np.ndarray, w: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, tied): the positions of text, sorted by at least `depth` bytes from there on, by Larsson and
    Sadakane's refinement, and whether one still shares the group of the one before.

    Suffixes are first sorted by eight bytes. As long as some share a group, those are sorted by the
    group of the suffix that starts as many bytes later as are sorted already; so that number doubles with each
    round, and suffixes that are alone in their group are not touched again.
    """
    n = len(text)
    order = np.argsort(w[:n])
    key = w[order]
    first = np.ones(n + 1, bool)
    first[1:n] = key[1:] != key[:-1]
    group = np.zeros(n + depth * 2, np.int64)  # 0: beyond the text
    group[order] = np.maximum.accumulate(np.where(first[:n], np.arange(n), 0)) + 1
    done = 8
    while done < depth:
        open_ = np.flatnonzero(~(first[:n] & first[1:]))
        if not len(open_):
            break
        at = order[open_]
        pair = (group[at] << 32) | group[at + done]
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[open_] = at
        starts = np.r_[True, pair[1:] != pair[:-1]]
        first[open_] = starts
        group[at] = np.maximum.accumulate(np.where(starts, open_, 0)) + 1
        done *= 2
    return order, ~first[:n]


def common_prefixes(w: np.ndarray, order: np.ndarray, tied: np.ndarray, most: int, inside: int) -> np.ndarray:
    """Of each suffix in order, how many bytes it shares with the one before, up to `most`; Kasai's way.

    Tied ones share more than was asked for. In text order, any other shares with its predecessor at least one
    byte less than the suffix one position earlier did, unless that was tied. Every eighth position is compared
    in full; the seven after it go on from what they must share at least. Positions from `inside` on, whose bytes run
    into the end, bound no other.
    """
    n, step = len(order), 8
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    before[order[tied]] = -2
    shared = np.zeros(n, np.int64)
    for t in range(step):
        at = np.arange(t, n, step)
        if t:
            bound = (before[at - t] >= 0) & (before[at - t] < inside) & (at < inside)
            shared[at] = np.where(bound, np.maximum(shared[at - t] - t, 0), 0)
        at = at[before[at] >= 0]
        while len(at):
            different = w[np.minimum(at + shared[at], len(w) - 1)] ^ w[np.minimum(before[at] + shared[at], len(w) - 1)]
            equal = np.full(len(at), 8)
            for k in range(8):
                equal[different >= U64(1 << (8 * k))] = 7 - k
            shared[at] += equal
            at = at[(equal == 8) & (shared[at] < most + step)]
    shared[before == -1], shared[before == -2] = 0, most
    return np.minimum(shared[order], most)


def window_groups(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, group): the windows that start at `starts`, sorted by their bytes, and a number for each distinct one, ascending."""
    inside = len(text)
    text = np.r_[text, np.zeros(2 * length, np.uint8)]  # so that all windows are sorted by bytes before the end
    w = words(text)
    order, tied = suffix_array(text, w, length)
    group = np.cumsum(common_prefixes(w, order, tied, length, inside) < length)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    keep = wanted[order]
    return order[keep], group[keep]
