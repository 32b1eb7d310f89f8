"""Order of suffixes by mergesort, two suffixes compared by hashes of their prefixes.

A polynomial hash of every prefix of a buffer gives the hash of any substring in constant time, so a binary search over
lengths finds how far two suffixes agree, and the byte behind that decides which is less: a comparison takes a number of
steps that is logarithmic in the length. All comparisons of a step of the mergesort are made at once over arrays. The
order is verified on the bytes afterwards: neighbours must agree as far as the hashes say and no further, which proves
the whole order; where a collision has misled it, the buffer is sorted by its bytes.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random odd number for each byte.
_VALUE = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLES: dict[int, np.ndarray] = {}
#: Pairs whose bytes are compared at a time.
_PAIRS = 1 << 14


def _powers(of: int, n: int) -> np.ndarray:
    """The powers 0 to ``n`` of a number modulo 2^64, kept and doubled when more are needed."""
    table = _TABLES.get(of)
    if table is None or len(table) <= n:
        size = 1 << max(16, int(n).bit_length())
        table = np.full(size, of, np.uint64)
        table[0] = 1
        _TABLES[of] = np.cumprod(table, dtype=np.uint64)
    return _TABLES[of]


class Prefixes:
    """Hashes of all prefixes of ``data`` (bytes as uint8)."""

    def __init__(self, data: np.ndarray):
        self.data, self.sums = data, np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * _powers(_BASE, len(data))[: len(data)], out=self.sums[1:])
        self.scale = _powers(_INVERSE, len(data))

    def grams(self, size: int) -> np.ndarray:
        """The hash of every substring of ``size`` bytes, mixed."""
        h = (self.sums[size:] - self.sums[: len(self.sums) - size]) * self.scale[: len(self.sums) - size]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


class Suffixes:
    """Suffixes of a buffer that begin at ``begin`` and of which ``length`` bytes count."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray):
        self.longest = int(length.max(initial=0))
        self.data = np.concatenate([data, np.zeros(self.longest + 9, np.uint8)])
        hashed = Prefixes(self.data)
        self.sums, self.scale = hashed.sums, hashed.scale[begin]
        self.begin, self.length = begin.astype(np.int64), length.astype(np.int64)
        eight = np.lib.stride_tricks.sliding_window_view(self.data, 8)[self.begin].copy()
        eight[np.arange(8) >= self.length[:, None]] = 0
        self.head = np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes agree in: the longest prefix with equal hashes, by binary search."""
        at_a, at_b, scale_a, scale_b = self.begin[a], self.begin[b], self.scale[a], self.scale[b]
        from_a, from_b = self.sums[at_a], self.sums[at_b]
        low, high = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        for _ in range(self.longest.bit_length()):
            middle = (low + high + 1) >> 1
            same = (self.sums[at_a + middle] - from_a) * scale_a == (self.sums[at_b + middle] - from_b) * scale_b
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix ``a`` comes before suffix ``b``; equal ones don't."""
        out = self.head[a] < self.head[b]
        tied = np.flatnonzero(self.head[a] == self.head[b])
        if len(tied):
            a, b = a[tied], b[tied]
            same = self.common(a, b)
            ended = same == np.minimum(self.length[a], self.length[b])
            out[tied] = np.where(ended, self.length[a] < self.length[b], self.data[self.begin[a] + same] < self.data[self.begin[b] + same])
        return out

    def in_order(self, order: np.ndarray, same: np.ndarray, apart: np.ndarray) -> bool:
        """Whether the bytes bear out ``order`` and how far neighbours agree; ``apart`` marks the first of each group."""
        rows = np.lib.stride_tricks.sliding_window_view(self.data, max(1, self.longest))
        for at in range(1, len(order), _PAIRS):
            part = np.arange(at, min(len(order), at + _PAIRS))
            part = part[~apart[part]]
            a, b, n = order[part - 1], order[part], same[part]
            agree = (rows[self.begin[a]] == rows[self.begin[b]]) | (np.arange(max(1, self.longest)) >= n[:, None])
            ended = n == np.minimum(self.length[a], self.length[b])
            right = np.where(ended, self.length[a] <= self.length[b], self.data[self.begin[a] + n] < self.data[self.begin[b] + n])
            if not (agree.all() and right.all()):
                return False
        return True


def _ranks(suffixes: Suffixes, order: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, ties: bool) -> np.ndarray:
    """For each suffix ``of`` the first place in the sorted run [low, high) that it goes before (``ties``: behind its equals)."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) >> 1
        other = order[middle]
        behind = ~suffixes.less(of[open_], other) if ties else suffixes.less(other, of[open_])
        low[open_], high[open_] = np.where(behind, middle + 1, low[open_]), np.where(behind, high[open_], middle)
    return low


def suffix_order(data: np.ndarray, begin: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes within their groups, equal ones as they came, and how many bytes each agrees in with the one
    before it (0 for the first of a group). ``group`` must not fall. No suffixes give two empty arrays."""
    n = len(begin)
    order = np.arange(n)
    if not n:
        return order, np.zeros(0, np.int64)
    suffixes = Suffixes(data, begin, length)
    apart = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.flatnonzero(apart)
    number = np.cumsum(apart) - 1
    opens, closes = first[number], np.append(first[1:], n)[number]  # of each place's group
    run = 1
    while run < (closes - opens).max():
        at = np.arange(n)
        middle = opens + (at - opens) // (2 * run) * (2 * run) + run  # runs are counted from where their group opens
        meets = middle < closes
        at, middle = at[meets], middle[meets]
        left = at < middle
        low = np.where(left, middle, middle - run)
        high = np.where(left, np.minimum(middle + run, closes[at]), middle)
        to = np.empty(len(at), np.int64)
        for side, ties in ((left, False), (~left, True)):
            rank = _ranks(suffixes, order, order[at[side]], low[side], high[side], ties)
            to[side] = at[side] + rank - (low[side] if not ties else high[side])
        order[to] = order[at]
        run *= 2
    same = np.zeros(n, np.int64)
    inside = np.flatnonzero(~apart)
    same[inside] = suffixes.common(order[inside - 1], order[inside])
    if not suffixes.in_order(order, same, apart):
        return _by_bytes(suffixes, apart, number)
    return order, same


def _by_bytes(suffixes: Suffixes, apart: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    body = [suffixes.data[b : b + n].tobytes() for b, n in zip(suffixes.begin, suffixes.length, strict=True)]
    order = sorted(range(len(body)), key=lambda i: (number[i], body[i]))
    same = np.zeros(len(body), np.int64)
    for at in np.flatnonzero(~apart):
        a, b = body[order[at - 1]], body[order[at]]
        same[at] = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return np.array(order, np.int64), same
