"""Texts to ids of a given byte-level vocabulary.

A vocabulary is a table of byte strings in the order in which a training run, somewhere else, merged them; nothing is
trained here. A text is cut into words by a pattern in the JVM and stays where it is: nothing is exchanged or staged. A task
splits the distinct words of a batch into the vocabulary's parts, remembers them, and sets them in for all occurrences.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.operators.hooks import slices

# fixed value: how byte-level vocabularies cut texts into words
PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_ENTRIES = 1 << 21  # a vocabulary is sent to every executor
MOST_KNOWN_BYTES = 64 << 20  # of words that a task remembers
ENTRY_BYTES = 200  # about what a remembered word takes beside its characters and ids


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a file of lines ``base64 rank``. Every single byte must be in it."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    if len(ranks) > MOST_ENTRIES or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} is no byte-level vocabulary of at most {MOST_ENTRIES} entries")
    return ranks


def split_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: neighbouring parts are merged, the pair of the lowest rank first, until none is in the vocabulary.

    Pairs wait in a heap; one whose parts have changed since is passed over. So a word of n bytes takes n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins at a byte
    pairs = [(ranks[pair], i, i + 1, i + 2) for i in range(n - 1) if (pair := word[i : i + 2]) in ranks]
    heapify(pairs)

    def offer(i: int) -> None:
        middle = end[i]
        if middle < n and (rank := ranks.get(word[i : end[middle]])) is not None:
            heappush(pairs, (rank, i, middle, end[middle]))

    while pairs:
        _, first, middle, last = heappop(pairs)
        if end[first] != middle or end[middle] != last:
            continue
        end[first], end[middle], before[last] = last, 0, first
        offer(first)
        if before[first] >= 0:
            offer(before[first])
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : end[at]]])
        at = end[at]
    return ids


class KnownWords:
    """``split_word`` by one vocabulary, remembering words as far as ``most`` bytes reach; then it begins anew."""

    def __init__(self, ranks: dict[bytes, int], most: int) -> None:
        self.ranks, self.most, self.used, self.known = ranks, most, 0, {}

    def ids(self, word: str) -> bytes:
        """The ids as 32-bit integers."""
        found = self.known.get(word)
        if found is None:
            found = array("i", split_word(word.encode(), self.ranks)).tobytes()
            size = ENTRY_BYTES + 4 * len(word) + len(found)
            if self.used + size > self.most:
                self.known, self.used = {}, 0
            if size <= self.most:
                self.known[word] = found
                self.used += size
        return found


def _ids_of(words: pa.ListArray, known: KnownWords) -> pa.ListArray:
    """The ids of each row's words, one list a row. Every distinct word is looked at once."""
    coded = words.flatten().dictionary_encode()
    met = pa.array([known.ids(w) for w in coded.dictionary.to_pylist()], pa.large_binary()).take(coded.indices)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(met).to_numpy(zero_copy_only=False) // 4)])
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, met.buffers()[2] or pa.py_buffer(b"")])
    rows = words.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(ends[rows - rows[0]], pa.int32()), values)


def encode_subwords(
    docs: DataFrame, key: str, text: str, ranks: dict[bytes, int], pattern: str = PATTERN, max_broadcast_bytes: int = MOST_KNOWN_BYTES
) -> DataFrame:
    """``(key, ids)``: the ids of every text in order, one row a row. A NULL or empty text has none.

    One pass over the texts, by which only the vocabulary is broadcast. ``max_broadcast_bytes`` is what a task keeps beside
    it: the ids of words it has met. Fewer cost time, not memory or results.
    """
    cut = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KnownWords(shared.value, max_broadcast_bytes)
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), _ids_of(part.column(1), known)], names=[key, "ids"])

    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(key, cut.alias("words")).mapInArrow(run, schema)
