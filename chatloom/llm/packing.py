"""Packing token ids into sequences of a fixed length by shortest-pack-first over the length histogram.

1. Texts become ids once, with an end id; documents longer than a sequence are cut into whole sequences and a rest. The
   pieces are written to the shared folder with their input partition and their count so far of equal pieces in it.
2. How many pieces there are of each length is all that packing needs: at most ``capacity`` numbers. Lengths are placed
   longest first, each into the emptiest pack that has room, for all packs of one pattern at a time. The result is a list
   of patterns with counts, whose size depends on the number of lengths, not of documents.
3. A piece's rank among those of its length is its partition's first rank plus its count; the rank tells its pattern, its
   sequence and its offset. Only narrow columns are shuffled for that, never the ids.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.session import stage

CAPACITY, END_ID = 2048, 1
ROWS = 512  # texts that a task holds as ids at a time


# ---- ids ---------------------------------------------------------------------------------------------------

# fixed values: how byte-level vocabularies split texts, and the bytes that they print as themselves
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Letters, digits and blanks up to here are the same in every edition of Unicode, hence for any two regex engines.
BEYOND = re.compile("[^\x00-ɏ]")


def _byte_of_char() -> dict[str, int]:
    others = [b for b in range(256) if b not in PRINTED]
    return {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def encoder(path: str, added: bool = False) -> Callable[[str], list[int]]:
    """ids of a text, none put around it, by the byte-level vocabulary file (JSON) at ``path``.

    The strings of added tokens in a text are ordinary text, or with ``added`` these tokens, as by the library's default.
    The file's own library is exact for any text and slow; a second one reads the same ranks several times as fast and
    takes the texts on which the two can't differ.
    """
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = not added
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    apart = re.compile("|".join(map(re.escape, sorted(special)))) if added and special else None
    of_char = _byte_of_char()
    ranks = {bytes(of_char[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if BEYOND.search(text) or (apart and apart.search(text)):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


def _tokenizer(path: str, capacity: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, added=True)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            owner, start, length, ids, total, nth = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = np.array([*encode(text or ""), end_id], "<u4")
                for at in range(0, len(own), capacity):
                    piece = own[at : at + capacity]
                    owner.append(i)
                    start.append(at)
                    length.append(len(piece))
                    ids.append(piece.tobytes())
                    total.append(len(own))
                    nth.append(int(seen[len(piece)]))
                    seen[len(piece)] += 1
            columns = [batch.column(0).take(pa.array(owner, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
            columns += [pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "length", "ids", "doc_tokens", "_nth"])

    return run


# ---- patterns ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Packs:
    """``count`` packs filled alike: ``times`` pieces of ``length`` behind those of ``before``."""

    count: int
    length: int
    times: int
    before: _Packs | None
    used: int

    def add(self, count: int, length: int, times: int) -> _Packs:
        return _Packs(count, length, times, self, self.used + length * times)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(packs, [(length, times), ...])]: patterns that hold just the pieces of ``histogram``, {length: pieces}."""
    heap: list[tuple[int, int, _Packs]] = []
    made = 0

    def push(packs: _Packs) -> None:
        nonlocal made
        made += 1
        heapq.heappush(heap, (packs.used, made, packs))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not heap or capacity - heap[0][0] < length:
                fits = capacity // length
                for count, times in ((left // fits, fits), (1, left % fits)):
                    if count and times:
                        push(_Packs(count, length, times, None, length * times))
                break
            used, _, packs = heapq.heappop(heap)
            room = (capacity - used) // length
            level = (heap[0][0] - used) // length if heap else room
            times = max(1, min(room, level, left // packs.count))
            if left < packs.count:  # some of these packs get one, the others stay as they are
                push(_Packs(packs.count - left, packs.length, packs.times, packs.before, packs.used))
                push(packs.add(left, length, 1))
                break
            push(packs.add(packs.count, length, times))
            left -= packs.count * times
    patterns = []
    for _, _, packs in sorted(heap, key=lambda x: x[:2]):
        content, at = [], packs
        while at is not None:
            content.append((at.length, at.times))
            at = at.before
        patterns.append((packs.count, content[::-1]))
    return patterns


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, packs, first sequence, offset), sorted: where the pieces of each length go by rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for count, content in patterns:
        offset = 0
        for length, times in content:
            rows.append((length, rank.get(length, 0), count, sequence, offset))
            rank[length] = rank.get(length, 0) + count * times
            offset += length * times
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placer(table: np.ndarray) -> Callable:
    first = {int(n): np.flatnonzero(table[:, 0] == n) for n in np.unique(table[:, 0])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                own = table[first[int(n)]]
                slot = own[np.searchsorted(own[:, 1], rank[rows], "right") - 1]
                turn, pack = np.divmod(rank[rows] - slot[:, 1], slot[:, 2])
                sequence[rows], offset[rows] = slot[:, 3] + pack, slot[:, 4] + turn * n
            columns = [*batch.columns, pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "sequence_id", "offset"])

    return run


# ---- the operator ------------------------------------------------------------------------------------------


@dataclass
class Packed:
    """``pieces``: (piece, key, start, length, doc_tokens, sequence_id, offset); ``tokens``: (piece, ids).

    ``ids`` are little-endian unsigned 32-bit numbers.
    """

    pieces: DataFrame
    tokens: DataFrame
    capacity: int

    def sequences(self) -> DataFrame:
        """(sequence_id, ids): the pieces of each sequence, in order, put together."""
        own = self.pieces.join(self.tokens, "piece").groupBy("sequence_id")
        parts = own.agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # at most ``capacity`` ids
        return parts.select("sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> Packed:
    """Every id of every document in exactly one piece, every piece in one sequence of at most ``capacity`` ids.

    A NULL text counts as empty and is one piece of the end id alone. Rows with equal or NULL keys are packed like any
    others; an empty table gives no pieces. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(
        _tokenizer(vocabulary, capacity, end_id),
        f"key {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, _nth bigint",
    )
    part, number = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("piece")
    tokens = stage(made.select("*", part, number), "tokens")

    counts = tokens.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stage(counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # <= capacity rows
    table = slots(shortest_pack_first(histogram, capacity))

    narrow = tokens.select("piece", "key", "start", "length", "doc_tokens", "_part", "_nth")
    ranked = narrow.join(counts.select("_part", "length", "_first"), ["_part", "length"])
    ranked = ranked.select("piece", "key", "start", "length", "doc_tokens", (F.col("_first") + F.col("_nth")).alias("_rank"))
    placed = ranked.mapInArrow(
        _placer(table), f"piece bigint, key {kind}, start bigint, length bigint, doc_tokens bigint, _rank bigint, sequence_id bigint, offset bigint"
    )
    return Packed(placed.drop("_rank").withColumnRenamed("key", key), tokens.select("piece", "ids"), capacity)
