"""Edit distances between two sets of strings, all or some pairs at once, by bit-parallel columns over numpy arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

WORD = 64
BAGS = 64  # that characters are counted in, by code point
LEVELS = 4  # up to which a bag's count is told apart
CELLS = 1 << 15  # pairs at a time


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (texts x longest, 0 past an end) and lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(size.max(initial=0))), np.uint32)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


def distances(patterns: list[str], texts: list[str]) -> np.ndarray:
    """Edit distances (patterns x texts); patterns longer than a machine word are compared column by column."""
    out = np.zeros((len(patterns), len(texts)), np.int64)
    if not patterns or not texts:
        return out
    codes, size = _codes(texts)
    order = np.argsort(-size, kind="stable")
    codes, size = codes[order], size[order]
    live = (size[:, None] > np.arange(codes.shape[1])).sum(axis=0)  # texts that reach each position
    alphabet, spelt = np.unique(codes, return_inverse=True)
    spelt = spelt.reshape(codes.shape)
    lengths = np.array([len(p) for p in patterns], np.int64)
    short = np.flatnonzero((lengths > 0) & (lengths <= WORD))
    step = max(1, CELLS // len(texts))
    for a in range(0, len(short), step):
        rows = short[a : a + step]
        found = _short([patterns[r] for r in rows], lengths[rows], alphabet, spelt, size, live)
        out[np.ix_(rows, order)] = found
    for r in np.flatnonzero(lengths == 0):
        out[r, order] = size
    for r in np.flatnonzero(lengths > WORD):
        out[r, order] = _long(patterns[r], codes, size)
    return out


class Bags:
    """Characters counted in bags, which bound how much two strings have in common and so how near they can be."""

    def __init__(self, texts: list[str]):
        codes, self.size = _codes(texts)
        count = np.zeros((len(texts), BAGS), np.int32)
        row, col = np.nonzero(np.arange(codes.shape[1]) < self.size[:, None])
        np.add.at(count, (row, codes[row, col] % BAGS), 1)
        self.levels = (count[:, :, None] > np.arange(LEVELS)).reshape(len(texts), -1).astype(np.float32)
        self.beyond = np.maximum(count - LEVELS, 0).sum(axis=1)

    def bounds(self, rows: slice, others: Bags) -> np.ndarray:
        """What the edit distances of some of these strings to all ``others`` are at least."""
        shared = self.levels[rows] @ others.levels.T + np.minimum(self.beyond[rows, None], others.beyond[None, :])
        return np.maximum(self.size[rows, None], others.size[None, :]) - shared


class Pairs:
    """Edit distances of chosen pairs of patterns and texts."""

    def __init__(self, patterns: list[str], texts: list[str]):
        self.patterns, self.lengths = patterns, np.array([len(p) for p in patterns], np.int64)
        self.codes, self.size = _codes(texts)
        alphabet, spelt = np.unique(self.codes, return_inverse=True)
        self.spelt = spelt.reshape(self.codes.shape)
        self.equal = _equal(patterns, alphabet)

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        length = self.lengths[a]
        out[length == 0] = self.size[b[length == 0]]
        short = np.flatnonzero((length > 0) & (length <= WORD))
        short = short[np.argsort(-self.size[b[short]], kind="stable")]
        for k in range(0, len(short), CELLS):
            at = short[k : k + CELLS]
            p, t = a[at], b[at]
            live = (self.size[t][:, None] > np.arange(self.size[t[0]])).sum(axis=0)
            out[at] = _columns(self.lengths[p], lambda m, j: self.equal[p[:m], self.spelt[t[:m], j]], live)  # noqa: B023
        for p in np.unique(a[length > WORD]):
            at = np.flatnonzero(a == p)
            out[at] = _long(self.patterns[p], self.codes[b[at]], self.size[b[at]])
        return out


def _columns(lengths: np.ndarray, equal: Callable[[int, int], np.ndarray], live: np.ndarray) -> np.ndarray:
    """Edit distances of pairs in descending order of text length; ``live`` texts reach each position."""
    n, one, last = len(lengths), np.uint64(1), (lengths - 1).astype(np.uint64)
    up, down, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), lengths.copy()
    for j, m in enumerate(live):
        eq, pv, mv = equal(m, j), up[:m], down[:m]
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score[:m] += ((ph >> last[:m]) & one).astype(np.int64) - ((mh >> last[:m]) & one).astype(np.int64)
        ph = (ph << one) | one
        xv = eq | mv
        up[:m], down[:m] = (mh << one) | ~(xv | ph), ph & xv
    return score


def _equal(patterns: list[str], alphabet: np.ndarray) -> np.ndarray:
    """Where each character stands in each pattern, a bit a position; patterns longer than a word have none."""
    where = {int(c): k for k, c in enumerate(alphabet)}
    equal = np.zeros((len(patterns), len(alphabet)), np.uint64)
    for k, p in enumerate(patterns):
        for j, c in enumerate(p if len(p) <= WORD else ""):
            if ord(c) in where:
                equal[k, where[ord(c)]] |= np.uint64(1 << j)
    return equal


def _short(patterns: list[str], lengths: np.ndarray, alphabet: np.ndarray, spelt: np.ndarray, size: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Vertical differences of a whole column in one word (Myers; Hyyro's form for whole strings)."""
    equal = _equal(patterns, alphabet)
    n = len(size)
    one, last = np.uint64(1), (lengths - 1).astype(np.uint64)[:, None]
    up = np.full((len(patterns), n), ~np.uint64(0))
    down = np.zeros_like(up)
    score = np.repeat(lengths[:, None], n, axis=1)
    for j, m in enumerate(live):
        eq, pv, mv = equal[:, spelt[:m, j]], up[:, :m], down[:, :m]
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score[:, :m] += ((ph >> last) & one).astype(np.int64)
        score[:, :m] -= ((mh >> last) & one).astype(np.int64)
        ph = (ph << one) | one
        xv = eq | mv
        up[:, :m] = (mh << one) | ~(xv | ph)
        down[:, :m] = ph & xv
    return score


def _long(pattern: str, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    n, longest = codes.shape
    before = np.repeat(np.arange(longest + 1)[None, :], n, axis=0)
    for i, c in enumerate(pattern, 1):
        now = np.empty_like(before)
        now[:, 0] = i
        differ = codes != ord(c)
        for j in range(1, longest + 1):
            now[:, j] = np.minimum(np.minimum(before[:, j], now[:, j - 1]) + 1, before[:, j - 1] + differ[:, j - 1])
        before = now
    return before[np.arange(n), size]
