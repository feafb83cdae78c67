"""Sorting suffixes by their first bytes with hash comparisons.

Two suffixes are compared by the length of their common beginning, which a binary search finds from prefix polynomial
hashes in a logarithmic number of steps; the byte behind it decides. The merge sort runs all merges of a level at once,
each element finding its place in the partner run by binary search. Equality is told by hashes alone at first and verified
byte by byte at the end.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
VERIFIED = 1 << 13  # pairs of neighbours compared at a time
_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class PrefixHashes:
    """Polynomial hash modulo 2**64 of any part of ``data`` (uint8) from sums over its prefixes."""

    _up = _powers(BASE, 0)
    _down = _powers(_INVERSE, 0)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if n + 1 > len(PrefixHashes._up):
            PrefixHashes._up, PrefixHashes._down = _powers(BASE, n + 1), _powers(_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self._down[start]

    def every(self, length: int) -> np.ndarray:
        """Hashes of all parts of one length, mixed so that their order is as good as random."""
        n = max(0, len(self.sums) - length)
        return _mixed((self.sums[length:] - self.sums[:n]) * self._down[:n])


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def hashes_of(parts: np.ndarray) -> np.ndarray:
    """Hash of each row of bytes, as ``PrefixHashes.every`` has it for such a part."""
    return _mixed((parts.astype(np.uint64) + np.uint64(1)) @ _powers(BASE, parts.shape[1]))


def common(hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, horizon: int) -> np.ndarray:
    """How many first bytes, ``horizon`` at most, the suffixes at ``a`` and ``b`` share."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), horizon, np.int64)
    for _ in range(horizon.bit_length()):
        mid = (low + high + 1) >> 1
        same = hashes.of(a, mid) == hashes.of(b, mid)
        low = np.where(same, mid, low)
        high = np.where(same, high, np.maximum(mid - 1, low))
    return low


def sort_suffixes(data: np.ndarray, hashes: PrefixHashes, start: np.ndarray, group: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the suffixes at ``start`` sorted by their first ``horizon`` bytes inside each group, and whether
    each differs from the one before it. ``group`` must not fall."""
    n = len(start)
    index = np.arange(n)
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else index
    sizes = np.diff(np.append(begins, n))
    begin, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    order, local = index.copy(), index - begin
    width = 1
    while n and width < sizes.max():
        run = local // width
        partner = begin + (run ^ 1) * width
        active = np.flatnonzero(partner < begin + size)
        low = partner[active].copy()
        end = np.minimum(low + width, (begin + size)[active])
        first, left = low.copy(), (run[active] & 1) == 0
        own = start[order[active]]
        for _ in range(width.bit_length()):
            open_ = np.flatnonzero(low < end)
            if not len(open_):
                break
            mid = (low[open_] + end[open_]) >> 1
            other, mine = start[order[mid]], own[open_]
            shared = common(hashes, other, mine, horizon)
            inside = np.minimum(shared, horizon - 1)
            o, m = data[other + inside], data[mine + inside]
            smaller = np.where(shared == horizon, ~left[open_], o < m)  # of equal ones the left run's come first
            low[open_] = np.where(smaller, mid + 1, low[open_])
            end[open_] = np.where(smaller, end[open_], mid)
        place = index.copy()
        place[active] = begin[active] + (run[active] >> 1) * 2 * width + local[active] % width + (low - first)
        merged = np.empty(n, np.int64)
        merged[place] = order
        order = merged
        width *= 2
    if not n:
        return order, np.zeros(0, bool)
    sorted_ = start[order]
    differs = np.ones(n, bool)
    neighbours = np.flatnonzero(group[1:] == group[:-1])
    differs[neighbours + 1] = common(hashes, sorted_[neighbours], sorted_[neighbours + 1], horizon) < horizon
    # a hash that lied would join what the bytes keep apart
    equal = np.flatnonzero(~differs)
    span = np.arange(horizon)
    for at in range(0, len(equal), VERIFIED):
        part = equal[at : at + VERIFIED]
        wrong = (data[sorted_[part][:, None] + span] != data[sorted_[part - 1][:, None] + span]).any(1)
        if wrong.any():
            return _by_bytes(data, start, group, horizon)
    return order, differs


def _by_bytes(data: np.ndarray, start: np.ndarray, group: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """The same without hashes, for the case that two of them collided."""
    keys = [data[s : s + horizon].tobytes() for s in start.tolist()]
    order = np.array(sorted(range(len(start)), key=lambda i: (group[i], keys[i])), np.int64)
    differs = np.ones(len(start), bool)
    for i in range(1, len(order)):
        differs[i] = group[order[i]] != group[order[i - 1]] or keys[order[i]] != keys[order[i - 1]]
    return order, differs
