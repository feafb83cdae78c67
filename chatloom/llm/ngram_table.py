"""N-grams of whole texts, interned in an open-addressed NumPy table.

Words are found in the bytes of an Arrow column at once; every run of words is hashed by XXH64 (own vectorised form for up
to 31 bytes, the library beyond) and looked up in a table of slots by linear probing. Equal hashes are no proof: the bytes
of every occurrence are compared with those of the slot's holder, and what differs probes on. What comes back is one slot
for each occurrence, so that anything computed once for each slot is gathered for all its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 19  # occurrences that are interned together
TEXT_BYTES = 8 << 20  # texts that are cut into words together; a longer one by itself
INLINE = 32  # XXH64 has another form from here on

# fixed values: the primes of XXH64
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)

#: Byte to byte: A-Z lower-cased, 0 for what separates words.
_WORD = np.arange(256, dtype=np.uint8)
_WORD[[b for b in range(128) if not chr(b).isalnum()]] = 0
_WORD[ord("A") : ord("Z") + 1] += 32


@dataclass
class Grams:
    """Runs of words: ``row`` of the column, ``start`` and ``size`` in ``bytes`` (which is padded)."""

    bytes: np.ndarray
    row: np.ndarray
    start: np.ndarray
    size: np.ndarray


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def hashes(g: Grams) -> np.ndarray:
    """XXH64 (seed 0) of each run's bytes."""
    lanes, size = _lanes(g.bytes), g.size.astype(np.uint64)
    h = _P5 + size
    at, left = g.start.copy(), g.size.copy()
    for _ in range(INLINE // 8 - 1):
        full = left >= 8
        if not full.any():
            break
        k = _rotl(lanes[at[full]] * _P2, 31) * _P1
        h[full] = _rotl(h[full] ^ k, 27) * _P1 + _P4
        at[full] += 8
        left[full] -= 8
    tail = lanes[at]
    half = left >= 4
    mixed = _rotl(h ^ ((tail & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    h = np.where(half, mixed, h)
    tail = np.where(half, tail >> np.uint64(32), tail)
    left = np.where(half, left - 4, left)
    for i in range(3):
        mixed = _rotl(h ^ (((tail >> np.uint64(8 * i)) & np.uint64(0xFF)) * _P5), 11) * _P1
        h = np.where(left > i, mixed, h)
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    view = memoryview(g.bytes)
    for i in np.flatnonzero(g.size >= INLINE):
        h[i] = xxhash.xxh64_intdigest(view[g.start[i] : g.start[i] + g.size[i]])
    return h


def same_bytes(g: Grams, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether runs ``a[i]`` and ``b[i]`` are the same bytes."""
    lanes = _lanes(g.bytes)
    same = g.size[a] == g.size[b]
    open_, offset = np.flatnonzero(same), 0
    while len(open_):
        left = g.size[a[open_]] - offset
        unused = np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)
        differ = (lanes[g.start[a[open_]] + offset] ^ lanes[g.start[b[open_]] + offset]) << unused
        equal = differ == 0
        same[open_[~equal]] = False
        open_, offset = open_[equal & (left > 8)], offset + 8
    return same


@dataclass
class Table:
    """``slot[i]`` is the place of occurrence i; ``holder`` its first occurrence, ``count`` how many there are (-1, 0: free)."""

    slot: np.ndarray
    holder: np.ndarray
    count: np.ndarray


def intern(g: Grams, keys: np.ndarray | None = None) -> Table:
    keys = hashes(g) if keys is None else keys
    n = len(keys)
    capacity = 1 << max(3, (2 * n).bit_length())
    holder = np.full(capacity, -1, np.int64)
    place = (keys & np.uint64(capacity - 1)).astype(np.int64)
    todo = np.arange(n)
    while len(todo):
        at = place[todo]
        free = holder[at] < 0
        holder[at[free]] = todo[free]  # of several claims one stands; the others find its bytes equal or move on
        held = holder[at]
        hit = keys[held] == keys[todo]
        hit[hit] = same_bytes(g, held[hit], todo[hit])
        todo = todo[~hit]
        place[todo] = (place[todo] + 1) & (capacity - 1)
    return Table(place, holder, np.bincount(place, minlength=capacity))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row, start, end) of the words in the rows that ``offsets`` delimit."""
    low = _WORD[data]
    inside = low != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][np.diff(offsets) > 0] - offsets[0]  # a word ends with its row
    begins[first] = inside[first]
    last = first[first > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets - offsets[0], start, "right") - 1
    return low, row, start, end


def _spaced(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one blank between them."""
    size = end - start
    new_end = np.cumsum(size + 1) - 1
    new_start = new_end - size
    out = np.full(int(new_end[-1]) + 1 if len(size) else 0, 0x20, np.uint8)
    shift = np.repeat(start - new_start, size)
    at = np.arange(len(shift)) + np.repeat(new_start - (np.cumsum(size) - size), size)
    out[at] = low[at + shift]
    return out, new_start, new_end


def _columns(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings without NULLs."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def grams(texts: pa.Array, most: int = 1) -> Iterator[tuple[int, int, np.ndarray, Iterator[Grams]]]:
    """For consecutive rows of a column: (first row, rows, words of each, their runs of 1 to ``most`` words in blocks)."""
    data, offsets = _columns(texts)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + TEXT_BYTES, "right")) - 1)
        low, owner, start, end = _words(data[offsets[row] : offsets[stop]], offsets[row : stop + 1])
        if most > 1:
            low, start, end = _spaced(low, start, end)
        yield row, stop - row, np.bincount(owner, minlength=stop - row), _blocks(low, owner, start, end, most)
        row = stop


def _blocks(low: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> Iterator[Grams]:
    padded = np.concatenate([low, np.zeros(2 * INLINE, np.uint8)])
    for n in range(1, most + 1):
        for i in range(0, len(start) - n + 1, BLOCK):
            a = np.arange(i, min(i + BLOCK, len(start) - n + 1))
            a = a[owner[a] == owner[a + n - 1]]
            yield Grams(padded, owner[a], start[a], end[a + n - 1] - start[a])
