"""Vectorised word and shingle hashing shared by the operators on word shingles.

A word is a maximal run of ASCII letters, digits and non-ASCII characters, with A-Z folded to a-z;
everything works on the UTF-8 bytes of a text, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed in one piece; longer texts are cut between words, so temporary arrays stay bounded.
PIECE_BYTES = 1 << 20

_FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalnum():
        _FOLD[_b] = ord(chr(_b).lower())
    elif _b >= 0x80:
        _FOLD[_b] = _b
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POW = _powers(_BASE, PIECE_BYTES + 1)
_INV = _powers(_BASE_INV, PIECE_BYTES + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece_words(raw: np.ndarray) -> np.ndarray:
    folded = _FOLD[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = folded != 0
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(folded.astype(np.uint64) * _POW[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * _INV[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash for each word of the whole text, in order."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= PIECE_BYTES:
        return _piece_words(raw) if len(raw) else np.empty(0, np.uint64)
    out, at = [], 0
    while at < len(raw):
        end = min(at + PIECE_BYTES, len(raw))
        if end < len(raw):
            gaps = np.flatnonzero(_FOLD[raw[at:end]] == 0)
            # a single word longer than a piece is cut: the same text is always cut alike
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        out.append(_piece_words(raw[at:end]))
        at = end
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles in order; a text of fewer words, but not none, is one shingle."""
    if len(words) == 0:
        return words
    width = min(k, len(words))
    n = len(words) - width + 1
    acc = np.full(n, width, np.uint64)
    for j in range(width):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(acc)


def weighted_shingles(text: str | None, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and how often each occurs."""
    return np.unique(shingle_hashes(word_hashes(text), k), return_counts=True)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets.

    The sum over common elements d of 1 / sum_e max(x_e / x_d, y_e / y_d), taken in one sort of the
    weight ratios. Two empty sets have similarity 0.
    """
    (ka, wa), (kb, wb) = a, b
    common, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    # at scale 1/x_d: y_e * ratio_d exceeds x_e just for the elements with a smaller ratio
    below_y = np.concatenate([[0.0], np.cumsum(y)])[:-1]
    from_x = x.sum() - np.concatenate([[0.0], np.cumsum(x)])[:-1]
    total = (only_a + from_x) / x + (only_b + below_y) / y
    return float(min(1.0, (1.0 / total).sum()))


def batches(items: Iterator, most: int, size) -> Iterator[list]:
    """Lists of consecutive items whose sizes add up to at most `most`, or of one larger item."""
    out, total = [], 0
    for item in items:
        n = size(item)
        if out and total + n > most:
            yield out
            out, total = [], 0
        out.append(item)
        total += n
    if out:
        yield out
