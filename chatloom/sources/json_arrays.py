"""Large files that each hold one JSON array, read by many tasks.

Where an element of such a file begins cannot be told from a place in its middle: a bracket may be part of a string. So
the file is read twice, in byte ranges:

1. Every range is scanned under each assumption about its first byte: outside a string, inside one, or behind a backslash
   there. What it yields is a function: for each assumption the state at its end and by how much the depth has changed.
   These functions, one row of a few numbers for each range, are composed in the order of the ranges.
2. Now every range knows the state it begins in. It cuts the elements that begin in it, at the commas of depth one, and
   reads on behind its end until the last of them is complete.

Only bytes below 128 are looked at, so a range may begin within a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.sources.arrow_files import open_path

SPLIT_BYTES = 64 << 20
BLOCK = 4 << 20
FLUSH = 8 << 20  # of elements handed on together
QUOTE, BACKSLASH, COMMA, OPEN, CLOSE = b'"'[0], b"\\"[0], b","[0], b"[{", b"]}"

#: Each byte's change of depth; commas are structure as well.
_CHANGE = np.zeros(256, np.int8)
_CHANGE[list(OPEN)], _CHANGE[list(CLOSE)] = 1, -1
_STRUCTURE = _CHANGE != 0
_STRUCTURE[COMMA] = True


@dataclass(frozen=True)
class State:
    inside: bool = False  # a string
    escaped: bool = False  # the next byte is
    depth: int = 0


ASSUMED = (State(), State(inside=True), State(inside=True, escaped=True))


def real_quotes(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """(places of the quotes that begin or end a string, whether the byte after ``data`` is escaped)."""
    quotes = np.flatnonzero(data == QUOTE)
    slashes = np.flatnonzero(data == BACKSLASH)
    behind = np.empty(0, np.int64)
    if len(slashes):
        first = np.flatnonzero(np.concatenate([[True], np.diff(slashes) > 1]))
        size = np.diff(np.append(first, len(slashes)))
        odd = (size + (escaped & (slashes[first] == 0))) % 2 == 1
        behind = (slashes[first] + size)[odd]
    if escaped and len(data) and data[0] != BACKSLASH:
        behind = np.append(behind, 0)
    after = bool(len(behind) and (behind == len(data)).any()) if len(data) else escaped
    return quotes[~np.isin(quotes, behind)], after


def structure(data: np.ndarray, state: State) -> tuple[np.ndarray, np.ndarray, State]:
    """(places of brackets and commas outside strings, the depth behind each, the state at the end)."""
    quotes, escaped = real_quotes(data, state.escaped)
    places = np.flatnonzero(_STRUCTURE[data])
    outside = (np.searchsorted(quotes, places) + state.inside) % 2 == 0
    places = places[outside]
    depth = state.depth + np.cumsum(_CHANGE[data[places]], dtype=np.int64)
    inside = bool((len(quotes) + state.inside) % 2)
    return places, depth, State(inside, escaped, int(depth[-1]) if len(depth) else state.depth)


def _blocks(path: str, start: int, end: int) -> Iterator[np.ndarray]:
    system, inner = open_path(path)
    with system.open_input_file(inner) as f:
        f.seek(start)
        while start < end:
            data = f.read(min(BLOCK, end - start))
            if not data:
                return
            yield np.frombuffer(data, np.uint8)
            start += len(data)


def transitions(path: str, start: int, end: int) -> list[State]:
    """The state behind a range for each of ``ASSUMED`` at its beginning."""
    states = list(ASSUMED)
    for data in _blocks(path, start, end):
        states = [structure(data, s)[2] for s in states]
    return states


def elements(path: str, start: int, end: int, size: int, state: State) -> Iterator[bytes]:
    """The array's elements that begin in a range, blanks around them removed."""
    held: list[bytes] | None = None  # the beginning of an open element
    at = start
    for data in _blocks(path, start, size):
        places, depth, state = structure(data, state)
        change = _CHANGE[data[places]]
        # the array's own brackets, and the commas between its elements
        cuts = places[((depth == 1) & (change >= 0) & ((change == 0) | (data[places] == OPEN[0]))) | ((depth == 0) & (change < 0))]
        raw, before = data.tobytes(), 0
        for cut in cuts.tolist():
            if held is not None:
                found = (b"".join(held) + raw[before:cut]).strip()
                if found:
                    yield found
            if at + cut >= end:
                return
            held, before = ([] if data[cut] != CLOSE[0] else None), cut + 1
        if held is not None:
            held.append(raw[before:])
        at += len(data)
        if at >= end and held is None:
            return


def _first_byte(path: str) -> bytes:
    for data in _blocks(path, 0, BLOCK):
        return data.tobytes().removeprefix(b"\xef\xbb\xbf").lstrip()[:1]
    return b""


def ranges(files: list[tuple[str, int]], split: int) -> list[tuple[int, str, int, int, int]]:
    """(number, path, size, start, end) of the ranges, in order."""
    out = []
    for path, size in files:
        n = max(1, -(-size // split))
        edges = [size * i // n for i in range(n + 1)]
        out += [(len(out) + i, path, size, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return out


RANGE_SQL = "number bigint, path string, size bigint, start bigint, stop bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            if r["start"] == 0 and _first_byte(r["path"]) not in (b"[", b""):
                raise ValueError(f"{r['path']} is no JSON array")
            ends = transitions(r["path"], r["start"], r["stop"])
            columns = [[r["number"]] * 3, [0, 1, 2], [s.inside for s in ends], [s.escaped for s in ends], [s.depth for s in ends]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["number", "assumed", "inside", "escaped", "depth"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            held, size = [], 0
            for element in elements(r["path"], r["start"], r["stop"], r["size"], State(r["inside"], r["escaped"], r["depth"])):
                held.append(element.decode("utf-8", "replace"))
                size += len(element)
                if size > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])


def read_elements(spark: SparkSession, files: list[tuple[str, int]], split: int = SPLIT_BYTES) -> DataFrame:
    """``value``: the JSON text of every element of the arrays in ``files``, (path, bytes) each.

    One task for each range. What the driver handles is one row of numbers for each, like the splits of any other file.
    """
    shares = ranges(files, split)
    if not shares:
        return spark.createDataFrame([], "value string")
    found: dict[int, list[State]] = {}
    asked = spark.createDataFrame(shares, RANGE_SQL).repartitionById(len(shares), F.col("number").cast("int"))
    scanned = asked.mapInArrow(_scan, "number bigint, assumed bigint, inside boolean, escaped boolean, depth bigint")
    for r in scanned.collect():
        found.setdefault(r["number"], [State()] * 3)[r["assumed"]] = State(r["inside"], r["escaped"], r["depth"])
    told, state = [], State()
    for share in shares:
        number, start = share[0], share[3]
        state = State() if start == 0 else state
        told.append((*share, state.inside, state.escaped, state.depth))
        end = found[number][ASSUMED.index(State(state.inside, state.escaped))]
        state = State(end.inside, end.escaped, state.depth + end.depth)
    placed = spark.createDataFrame(told, RANGE_SQL + ", inside boolean, escaped boolean, depth bigint").repartitionById(len(shares), F.col("number").cast("int"))
    return placed.mapInArrow(_cut, "value string")
