"""Removal of byte strings that also start in a document with a smaller key.

Sorting every suffix of a corpus in one place can't work; sorting those that could match, where they meet, does.

1. Distinct texts are dealt into groups by their hash. A group picks anchors: of the 20-byte strings inside each 50-byte
   window the one with the least hash. Equal windows pick the same anchor at the same place. Groups send the first bits
   of the anchors' hashes, sorted and Golomb-coded, to owners, which answer by bitmaps with those that several groups have.
2. For shared anchors only, groups send the bytes around them that the anchor's windows cover: distinct contexts with
   the least and largest key they occur under, to the anchor's owner. The hash itself is not sent, the bytes have it.
3. Owners sort the contexts' suffixes (suffix_sort) and tell for each window the least key that has it.
4. Groups mark, in each text, the windows whose least key is smaller than its own.

Whatever a group holds twice is sent once, so a passage in a third of all documents is one context for each group. An
anchor with many different contexts is hot; its windows are dealt one by one by their own hash instead.

Every group has a message for every owner, so groups grow with the root of the data and messages keep a size that is worth
sending. The texts are exchanged once: the steps are one plan, which reads that exchange three times.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm import golomb
from chatloom.llm.common import whole
from chatloom.llm.exact_dedup import _cuts
from chatloom.llm.suffix_sort import PrefixHashes, hashes_of, sort_suffixes
from chatloom.session import stage

LENGTH, ANCHOR = 50, 20
SPREAD = LENGTH - ANCHOR + 1  # anchors to pick from in a window
WIDEST = LENGTH + SPREAD - 1  # bytes that the windows of one anchor cover
GROUP_BYTES = 2 << 20  # of text at least; a task holds some twenty times a group
MOST_GROUP, MESSAGES = 16, 128  # times GROUP_BYTES at most; messages that GROUP_BYTES of text go into at most, before that
MOST_OWNER_BITS = 17
SPARE_BITS = 4  # of an anchor's print beyond those of the number of bytes: one in some 250 looks shared and is not
RECORDS = 1 << 16  # contexts that are laid out at a time
ALONE = 255  # place of the anchor, where the window stands for itself
HOT_CONTEXTS, HOT_GROUPS = 64, 512
BLOCK = 1 << 18
FLUSH = 8 << 20
SORTED = 1 << 16  # suffixes that are sorted at a time
ROWS = 512  # of a batch that are Python objects at a time
LAST_KEY = (1 << 63) - 1  # of rows without one


def _dump(*values) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(values, 5))


def _load(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))  # noqa: S301 - written by this job


def _columns(values: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones: what is alike compresses."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    columns = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(columns.T).view(kind).reshape(-1)


# ---- groups of texts ---------------------------------------------------------------------------------------


def _group_bytes(total: int) -> int:
    """Of ``total`` bytes of text in a group. Messages are the square of the groups' number."""
    return max(GROUP_BYTES, min(GROUP_BYTES * MOST_GROUP, math.isqrt(total * GROUP_BYTES // MESSAGES)))


def _dealer(groups: int) -> Callable:
    """Batches (hash, key, text) to rows (group, blob): each distinct text of the task once, with its least key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        least: dict[bytes, int] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            by_group: dict[int, list] = {}
            for sha, text in held.items():
                by_group.setdefault(int.from_bytes(sha[:8], "big") % groups, []).append((sha, least[sha], text))
            for g, rows in by_group.items():
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([_dump(rows)], pa.binary())], names=["g", "blob"])
            held.clear()
            least.clear()

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            for sha, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if sha in held:
                    least[sha] = min(least[sha], key)
                    continue
                held[sha], least[sha] = text, key
                size += len(text)
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


class _Texts:
    """The distinct texts of a group, by hash: ``data`` end to end, ``ends``, ``keys``, ``shas``."""

    def __init__(self, table: pa.Table):
        found: dict[bytes, tuple[int, bytes]] = {}
        for blob in table["blob"]:
            for sha, key, text in _load(blob.as_py())[0]:
                found[sha] = (min(key, found[sha][0]) if sha in found else key, text)
        self.shas = sorted(found)
        self.keys = np.array([found[s][0] for s in self.shas], np.int64)
        sizes = np.array([len(found[s][1]) for s in self.shas], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.data = np.frombuffer(b"".join(found[s][1] for s in self.shas), np.uint8)

    def runs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(first window, last window, anchor's hash, anchor), in blocks.

        Windows with the same anchor follow one another; none crosses the end of a text.
        """
        last = len(self.data) - LENGTH
        for at in range(0, last + 1, BLOCK):
            stop = min(at + BLOCK, last + 1)
            grams = PrefixHashes(self.data[at : stop + LENGTH - 1]).every(ANCHOR)
            anchor = leftmost_minima(grams, SPREAD)
            window = np.arange(at, stop)
            owner = np.searchsorted(self.ends, window, "right")
            good = window + LENGTH <= self.ends[owner]
            window, anchor = window[good], anchor[good]
            if not len(window):
                continue
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)])
            first = np.flatnonzero(new)
            last_of = np.append(first[1:], len(window)) - 1
            yield window[first], window[last_of], spread(grams[anchor[first]]), anchor[first] + at

    def window_hashes(self, window: np.ndarray) -> np.ndarray:
        """Hash of each of these windows."""
        parts = [window[at : at + BLOCK // LENGTH] for at in range(0, len(window), BLOCK // LENGTH)]
        return np.concatenate([PrefixHashes(self.data[(p[:, None] + np.arange(LENGTH)).reshape(-1)]).every(LENGTH)[::LENGTH] for p in parts])

    def text_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, "right")


def spread(minima: np.ndarray) -> np.ndarray:
    """Other numbers for hashes, one to one: least ones crowd at the low end, where a few owners would have most of them."""
    h = minima * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Where the first least of every ``width`` neighbouring values is; ranges double until two of them cover a window."""
    least, place, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
        size += step
    return place


def _distinct(hashes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, whether several texts have each, how often each occurs)."""
    order = np.lexsort((texts, hashes))
    hashes, texts = hashes[order], texts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(hashes)))
    return hashes[first], texts[first] != texts[first + counts - 1], counts


# ---- 1: anchors --------------------------------------------------------------------------------------------


def _prints(hashes: np.ndarray, bits: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct first ``width`` bits of sorted hashes, where the owners' shares begin in them)."""
    short = np.unique(hashes >> np.uint64(64 - width))
    return short, _cuts(short << np.uint64(64 - width), bits)


def _anchor_sender(bits: int, width: int, hot_contexts: int) -> Callable:
    def send(table: pa.Table) -> pa.Table:
        texts = _Texts(table)
        found = [(h, texts.text_of(p)) for _, _, h, p in texts.runs()]
        rows = []
        if found:
            hashes, _, counts = _distinct(*(np.concatenate(x) for x in zip(*found)))
            short, cuts = _prints(hashes, bits, width)
            hot, hot_cuts = _prints(hashes[counts > hot_contexts], bits, width)
            for owner in np.flatnonzero(np.diff(cuts)):
                share = short[cuts[owner] : cuts[owner + 1]]
                own_hot = hot[hot_cuts[owner] : hot_cuts[owner + 1]].tobytes()
                code = golomb.encode(share, int(owner) << (width - bits), width - bits)
                rows.append((table["g"][0].as_py(), int(owner), pickle.dumps((len(share), *code, own_hot), 5)))
        return _rows(rows)

    return send


def _release() -> None:
    """Give freed memory back: a worker goes through many groups, whose arrays would leave its heap in holes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    _release()
    g, owner, blob = zip(*rows) if rows else ((), (), ())
    return pa.table({"g": pa.array(g, pa.int64()), "owner": pa.array(owner, pa.int64()), "blob": pa.array(blob, pa.binary())})


ROW_SQL = "g bigint, owner bigint, blob binary"


def _anchor_owner(bits: int, width: int) -> Callable:
    def answer(table: pa.Table) -> pa.Table:
        owner = table["owner"][0].as_py()
        groups = table["g"].to_pylist()
        sent = [pickle.loads(b.as_py()) for b in table["blob"]]  # noqa: S301 - written by this job
        shares = [golomb.decode(n, shift, high, low, owner << (width - bits)) for n, shift, high, low, _ in sent]
        every, counts = np.unique(np.concatenate(shares), return_counts=True)
        shared = every[counts > 1]
        hot = np.unique(np.concatenate([np.frombuffer(s[4], np.uint64) for s in sent] + [every[counts >= HOT_GROUPS]]))
        hot = hot[_in(hot, shared)]
        rows = []
        for g, share in zip(groups, shares):
            own = _in(share, shared)
            if own.any():
                rows.append((g, owner, _dump(np.packbits(own).tobytes(), np.packbits(_in(share, hot)).tobytes())))
        return _rows(rows)

    return answer


def _told(hashes: np.ndarray, answers: pa.Table, bits: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of a group's sorted distinct hashes the owners call shared, and hot."""
    short, cuts = _prints(hashes, bits, width)
    flags = np.zeros((2, len(short)), bool)
    for owner, blob in zip(answers["owner"].to_pylist(), answers["blob"]):
        share = slice(int(cuts[owner]), int(cuts[owner + 1]))
        for own, packed in zip(flags, _load(blob.as_py())):
            own[share] = np.unpackbits(np.frombuffer(packed, np.uint8), count=share.stop - share.start)
    shared, hot = flags[:, np.searchsorted(short, hashes >> np.uint64(64 - width))]
    return shared, hot


def _in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in ``among``, sorted and distinct."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


# ---- 2: contexts -------------------------------------------------------------------------------------------

VERIFIED = 1 << 14  # records whose bytes are compared at a time


def _keys(matrix: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(matrix[:, :8]).view(">u8").reshape(-1).astype(np.uint64)


def distinct_records(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows by key, the number of each row's): rows are sorted by key and hash, and neighbours compared by bytes."""
    factors = np.cumprod(np.full(matrix.shape[1], 0x9E3779B97F4A7C15, np.uint64))
    parts = [(matrix[at : at + VERIFIED].astype(np.uint64) + np.uint64(1)) @ factors for at in range(0, len(matrix), VERIFIED)]
    hashed, key = np.concatenate(parts) if parts else np.zeros(0, np.uint64), _keys(matrix)
    order = np.lexsort((hashed, key))
    new = np.ones(len(matrix), bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (hashed[order[1:]] != hashed[order[:-1]])
    same = np.flatnonzero(~new)
    for at in range(0, len(same), VERIFIED):
        part = same[at : at + VERIFIED]
        if (matrix[order[part]] != matrix[order[part - 1]]).any():  # a hash that lied
            found, which = np.unique(np.ascontiguousarray(matrix).view(f"V{matrix.shape[1]}").reshape(-1), return_inverse=True)
            return found.view(np.uint8).reshape(len(found), -1), which
    which = np.empty(len(matrix), np.int64)
    which[order] = np.cumsum(new) - 1
    return matrix[order[new]], which


def _laid_out(texts: _Texts, padded: np.ndarray, key: np.ndarray, first: np.ndarray, size: np.ndarray, rel: np.ndarray) -> np.ndarray:
    record = np.empty((len(first), 10 + WIDEST), np.uint8)
    record[:, :8] = key.astype(">u8").view(np.uint8).reshape(-1, 8)
    record[:, 8], record[:, 9] = size, rel
    record[:, 10:] = np.lib.stride_tricks.sliding_window_view(padded, WIDEST)[first]
    record[:, 10:][np.arange(WIDEST) >= size[:, None]] = 0
    return record


def _context_sender(bits: int, width: int) -> Callable:
    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([])
        texts = _Texts(table)
        g = table["g"][0].as_py()
        blocks = [(first, (last - first + LENGTH).astype(np.uint8), key, (anchor - first).astype(np.uint8), texts.text_of(anchor).astype(np.int32)) for first, last, key, anchor in texts.runs()]
        if not blocks:
            return _rows([])
        first, size, key, rel, text = (np.concatenate(x) for x in zip(*blocks))
        del blocks
        every, several, _ = _distinct(key, text)
        shared, hot = _told(every, answers, bits, width)
        at = np.searchsorted(every, key)
        use = (shared | several)[at]
        first, size, key, rel, alone = first[use], size[use], key[use], rel[use], hot[at[use]]
        del every, several, shared, hot, at, text
        if alone.any():
            count = size[alone].astype(np.int64) - LENGTH + 1
            window = np.repeat(first[alone], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            plain = ~alone
            key = np.concatenate([key[plain], texts.window_hashes(window)])
            rel = np.concatenate([rel[plain], np.full(len(window), ALONE, np.uint8)])
            first, size = np.concatenate([first[plain], window]), np.concatenate([size[plain], np.full(len(window), LENGTH, np.uint8)])
        if not len(first):
            return _rows([])
        padded = np.concatenate([texts.data, np.zeros(WIDEST, np.uint8)])
        order, which, base, rows = np.argsort(key, kind="stable"), np.empty(len(first), np.int32), 0, []
        for part in (order[at : at + RECORDS] for at in range(0, len(order), RECORDS)):
            matrix, number = distinct_records(_laid_out(texts, padded, key[part], first[part], size[part], rel[part]))
            which[part] = number + base
            keys_of = texts.keys[texts.text_of(first[part])]
            low, high = np.full(len(matrix), LAST_KEY, np.int64), np.full(len(matrix), -LAST_KEY - 1, np.int64)
            np.minimum.at(low, number, keys_of)
            np.maximum.at(high, number, keys_of)
            cuts = _cuts(_keys(matrix), bits)
            for owner in np.flatnonzero(np.diff(cuts)):
                share = slice(int(cuts[owner]), int(cuts[owner + 1]))
                rows.append((g, int(owner), _pack(base + share.start, matrix[share], low[share], high[share])))
            base += len(matrix)
        steps = np.diff(first, prepend=0)
        rows.append((g, -1 - g, _dump(_columns(which), _columns(steps))))
        return _rows(rows)

    return send


def _pack(base: int, matrix: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    """Contexts, numbered from ``base``, without their keys and without what is behind their end."""
    size, place, body = matrix[:, 8], matrix[:, 9], matrix[:, 10:]
    return _dump(base, size.tobytes(), place.tobytes(), _columns(low), _columns(high - low), body[np.arange(WIDEST) < size[:, None]].tobytes())


def _unpack(sent: list[bytes]) -> tuple[np.ndarray, ...]:
    """(contexts as ``least_keys`` takes them, their least and largest keys, their numbers, which message each is from)."""
    base, size, place, low, wide, body = zip(*map(_load, sent))
    count = np.array([len(s) for s in size])
    matrix = np.zeros((count.sum(), 10 + WIDEST), np.uint8)
    matrix[:, 8], matrix[:, 9] = np.frombuffer(b"".join(size), np.uint8), np.frombuffer(b"".join(place), np.uint8)
    matrix[:, 10:][np.arange(WIDEST) < matrix[:, 8:9]] = np.frombuffer(b"".join(body), np.uint8)
    for at in range(0, len(matrix), VERIFIED):
        part = matrix[at : at + VERIFIED]
        alone = part[:, 9] == ALONE
        part[alone, 9] = 0
        anchor = np.take_along_axis(part, 10 + part[:, 9:10].astype(np.int64) + np.arange(ANCHOR), 1)
        key = np.where(alone, hashes_of(part[:, 10 : 10 + LENGTH]), spread(hashes_of(anchor)))
        part[:, :8] = key.astype(">u8").view(np.uint8).reshape(-1, 8)
    low = np.concatenate([_numbers(x, np.int64) for x in low])
    high = low + np.concatenate([_numbers(x, np.int64) for x in wide])
    source = np.repeat(np.arange(len(sent)), count)
    return matrix, low, high, np.arange(len(matrix)) + np.repeat(np.array(base) - (np.cumsum(count) - count), count), source


# ---- 3: suffixes -------------------------------------------------------------------------------------------


def _sort_windows(
    answer: np.ndarray,
    data: np.ndarray,
    hashes: PrefixHashes,
    contexts: np.ndarray,
    number: np.ndarray,
    windows: np.ndarray,
    anchor: np.ndarray,
    least: np.ndarray,
) -> None:
    """Fill ``answer`` for the windows of these contexts: the least key among equal ones."""
    count = windows[contexts]
    context = np.repeat(contexts, count)
    step = np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count)
    # equal windows have their anchor at the same place
    group = np.repeat(number, count) * 256 + anchor[context].astype(np.int64) - step
    by_group = np.argsort(group, kind="stable")
    context, step, group = context[by_group], step[by_group], group[by_group]
    order, differs = sort_suffixes(data, hashes, context * WIDEST + step, group, LENGTH)
    starts = np.flatnonzero(differs)
    best = np.minimum.reduceat(least[context[order]], starts)
    answer[context[order], step[order]] = np.repeat(best, np.diff(np.append(starts, len(order))))


def least_keys(matrix: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Least key of each window of each context, (contexts x SPREAD), ``LAST_KEY`` where there is no window.

    ``matrix`` rows: key (8 bytes, big-endian), size, place of the anchor, the bytes; ``low``: each context's least key.
    """
    flat, which = distinct_records(matrix)
    least = np.full(len(flat), LAST_KEY, np.int64)
    np.minimum.at(least, which, low)
    key = _keys(flat)
    windows = flat[:, 8].astype(np.int64) - LENGTH + 1
    answer = np.where(np.arange(SPREAD) < windows[:, None], least[:, None], LAST_KEY)
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(begins, len(key)))
    several = np.flatnonzero(np.repeat(sizes > 1, sizes))
    if len(several):
        data = np.ascontiguousarray(flat[:, 10:]).reshape(-1)
        hashes = PrefixHashes(data)
        number = np.repeat(np.arange(len(begins)), sizes)[several]
        before = np.cumsum(windows[several]) - windows[several]
        first = np.maximum.accumulate(np.where(np.diff(number, prepend=-1) > 0, before, 0))
        edges = np.flatnonzero(np.diff(first // SORTED, prepend=-1))  # an anchor's contexts stay in one slice
        for begin, end in zip(edges, np.append(edges[1:], len(several))):
            part = slice(begin, end)
            _sort_windows(answer, data, hashes, several[part], number[part], windows, flat[:, 9], least)
    return answer[which]


def _context_owner(table: pa.Table) -> pa.Table:
    owner = table["owner"][0].as_py()
    if owner < 0:  # a group's places, on their way back to it
        return table
    matrix, low, high, number, source = _unpack([b.as_py() for b in table["blob"]])
    group = table["g"].to_numpy()[source]
    key = _keys(matrix)
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    edges = begins[np.diff(begins // RECORDS, prepend=-1) > 0]  # an anchor's contexts stay in one slice
    found = []
    for part in (order[begin:end] for begin, end in zip(edges, np.append(edges[1:], len(order)))):
        own = least_keys(matrix[part], low[part])
        # runs of windows with one least key, where some text with the context has a larger one
        use = own < high[part][:, None]
        new = use & (np.concatenate([np.ones((len(own), 1), bool), (own[:, 1:] != own[:, :-1]) | ~use[:, :-1]], axis=1))
        context, begin = np.nonzero(new)
        run = np.cumsum(new.reshape(-1)) - 1
        length = np.bincount(run[use.reshape(-1)], minlength=len(context))
        found.append((group[part][context], number[part][context].astype(np.int32), begin.astype(np.uint8), length.astype(np.uint8), own[context, begin]))
    group, context, begin, length, least = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((begin, context, group))
    group, context, begin, length, least = (x[order] for x in (group, context, begin, length, least))
    edges = np.flatnonzero(np.diff(group, prepend=-1))
    shares = [slice(a, b) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(group)])]
    return _rows([(int(group[s.start]), owner, _dump(_columns(context[s]), begin[s].tobytes(), length[s].tobytes(), _columns(least[s]))) for s in shares])


# ---- 4: removal --------------------------------------------------------------------------------------------

SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
RESULT_SQL = "sha binary, first_key bigint, spans array<struct<start: bigint, end: bigint>>, kept_sha256 string"


def _remover(table: pa.Table, told: pa.Table) -> pa.Table:
    _release()
    out: dict[str, list] = {"sha": [], "first_key": [], "spans": [], "kept_sha256": []}
    if table.num_rows:
        texts = _Texts(table)
        change = np.zeros(len(texts.data) + 1, np.int8)  # the runs over a byte begin at different ones of 50 windows
        places = [_load(b.as_py()) for o, b in zip(told["owner"].to_pylist(), told["blob"]) if o < 0]
        runs = [_load(b.as_py()) for o, b in zip(told["owner"].to_pylist(), told["blob"]) if o >= 0]
        if places and runs:
            which, first = _numbers(places[0][0], np.int32), np.cumsum(_numbers(places[0][1], np.int64))
            kinds = (np.int32, np.uint8, np.uint8, np.int64)
            context, begin, length, key = (np.concatenate([_numbers(x, kind) for x in column]) for kind, column in zip(kinds, zip(*runs)))
            order = np.argsort(context, kind="stable")
            context, begin, length, key = context[order], begin[order].astype(np.int64), length[order].astype(np.int64), key[order]
            lo, hi = np.searchsorted(context, which, "left"), np.searchsorted(context, which, "right")
            n = hi - lo
            place = np.repeat(np.arange(len(which)), n)
            run = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + lo[place]
            start = first[place] + begin[run]
            good = key[run] < texts.keys[texts.text_of(start)]
            np.add.at(change, start[good], 1)
            np.add.at(change, start[good] + length[run][good] - 1 + LENGTH, -1)
        covered = np.cumsum(change[:-1], dtype=np.int8) > 0
        for i, (begin, end) in enumerate(zip(texts.begins.tolist(), texts.ends.tolist())):
            own = covered[begin:end]
            edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            out["sha"].append(texts.shas[i])
            out["first_key"].append(int(texts.keys[i]))
            out["spans"].append([{"start": a, "end": b} for a, b in edges.tolist()])
            out["kept_sha256"].append(hashlib.sha256(texts.data[begin:end][~own].tobytes()).hexdigest())
    kinds = {"sha": pa.binary(), "first_key": pa.int64(), "spans": pa.list_(SPAN), "kept_sha256": pa.string()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """One row for each input row: ``key``, ``n_bytes``, ``spans`` (removed bytes, maximal runs), ``kept_sha256``.

    Texts are UTF-8 bytes, NULL is empty. A byte is removed if a 50-byte string over it also starts in a row with a
    smaller key; strings never cross rows and are judged on the input. ``key`` must be an integer; rows without one come
    behind all others and remove nothing from each other, nor do different rows with the same key. An empty table gives
    no rows; other columns are not read. ``hot_contexts`` only steers how anchors are dealt, not the result.
    """
    body = whole(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), body.alias("text"))
    sha = F.unhex(F.sha2("text", 256))
    order = F.coalesce("key", F.lit(LAST_KEY))
    prints = stage(rows.select("key", sha.alias("sha"), F.octet_length("text").cast("bigint").alias("n_bytes")), "prints")
    total = prints.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    groups = 1 + total // _group_bytes(total)
    bits = min(MOST_OWNER_BITS, (groups - 1).bit_length())
    width = min(64, max(bits, total.bit_length() + SPARE_BITS))

    # one exchange of texts, which the plan reads three times; with fewer partitions than the default a cogroup would deal them anew
    partitions = max(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = rows.select(sha.alias("sha"), order.alias("key"), F.col("text").cast("binary").alias("text"))
    by_group = texts.mapInArrow(_dealer(groups), "g bigint, blob binary").repartition(partitions, "g").groupBy("g")
    anchors = by_group.applyInArrow(_anchor_sender(bits, width, hot_contexts), ROW_SQL)
    shared = anchors.groupBy("owner").applyInArrow(_anchor_owner(bits, width), ROW_SQL)
    sent = by_group.cogroup(shared.groupBy("g")).applyInArrow(_context_sender(bits, width), ROW_SQL)
    told = sent.groupBy("owner").applyInArrow(_context_owner, ROW_SQL)
    result = stage(by_group.cogroup(told.groupBy("g")).applyInArrow(_remover, RESULT_SQL), "removed")

    copy = F.col("first_key") < order
    everything = F.when(F.col("n_bytes") >= LENGTH, F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end"))))
    return prints.join(result, "sha").select(
        F.col("key").alias(key),
        "n_bytes",
        F.when(copy, F.coalesce(everything, F.slice("spans", 1, 0))).otherwise(F.col("spans")).alias("spans"),
        F.when(copy & (F.col("n_bytes") >= LENGTH), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
