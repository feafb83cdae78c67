"""Vectors at rest: rows carry references, the numbers are fetched last.

A vector of a real model is some kilobytes, a reference sixteen bytes. So vectors are written once, by the tasks that make
or read them, into blocks of raw numbers in the shared folder; what joins, shuffles and sorts is a narrow index (key, block,
place). When a row has found its final place, ``fetch`` reads its vector row-locally, from blocks mapped into memory: no
plan moves an array of numbers between tasks.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.session import stage, staging_path
from chatloom.sources.arrow_files import open_path

BLOCK_BYTES = 64 << 20
OPEN_BLOCKS = 64  # mapped at a time; on other systems than a mounted one a block is held in memory
HELD_BLOCKS = 2
OUT_BYTES = 16 << 20  # of vectors handed on together
KINDS = {"float": np.dtype("<f4"), "double": np.dtype("<f8")}


@dataclass(frozen=True)
class Blocks:
    """Where vectors of ``size`` numbers of ``kind`` ("float" or "double") lie; ``index`` has the keys, ``block`` and ``place``."""

    folder: str
    size: int
    kind: str
    index: DataFrame


def _block_path(folder: str, block: int) -> str:
    return f"{folder}/{block:016x}"


def store_vectors(df: DataFrame, keys: Sequence[str], vector: str, size: int, kind: str = "float", beside: Blocks | None = None) -> Blocks:
    """Write the vectors of ``df`` where its tasks are; the index is staged.

    ``beside`` puts them into the folder of others of the same size and kind, so that one ``fetch`` reads both.

    A block has the number of the attempt that wrote it, and only blocks of attempts whose index rows were kept are ever
    read. A NULL vector, or one that does not have ``size`` numbers, is an error that names the key.
    """
    if beside is not None and (beside.size, beside.kind) != (size, kind):
        raise ValueError(f"vectors of {size} {kind} beside those of {beside.size} {beside.kind}")
    folder = beside.folder if beside is not None else staging_path(df.sparkSession, "vectors")
    dtype = KINDS[kind]
    per_block = max(1, BLOCK_BYTES // (size * dtype.itemsize))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_path(folder)
        system.create_dir(root, recursive=True)
        attempt, number, held, sink = TaskContext.get().taskAttemptId(), -1, per_block, None
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                if held == per_block:
                    if sink is not None:
                        sink.close()
                    number, held = number + 1, 0
                    block = (attempt << 20) + number
                    sink = system.open_output_stream(_block_path(root, block))
                part = batch.slice(done, per_block - held)
                column = part.column(part.num_columns - 1)
                if column.null_count or pa.compute.any(pa.compute.not_equal(pa.compute.list_value_length(column), size)).as_py():
                    bad = next(i for i, v in enumerate(column) if not v.is_valid or len(v) != size)
                    raise ValueError(f"no vector of {size} numbers: {[part.column(i)[bad].as_py() for i in range(len(keys))]}")
                sink.write(np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), dtype).tobytes())
                places = [pa.array(np.full(part.num_rows, block)), pa.array(np.arange(held, held + part.num_rows, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keys))] + places, names=[*keys, "block", "place"])
                held, done = held + part.num_rows, done + part.num_rows
        if sink is not None:
            sink.close()

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    made = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{vector}`")).mapInArrow(write, f"{kinds}, block bigint, place int")
    return Blocks(folder, size, kind, stage(made, "vector_index"))


class _Reader:
    """Blocks as matrices, the last few of them open."""

    def __init__(self, folder: str, size: int, dtype: np.dtype) -> None:
        (self.system, self.root), self.size, self.dtype = open_path(folder), size, dtype
        self.local = isinstance(self.system, pafs.LocalFileSystem)
        self.open: OrderedDict[int, np.ndarray] = OrderedDict()

    def matrix(self, block: int) -> np.ndarray:
        if block in self.open:
            self.open.move_to_end(block)
            return self.open[block]
        path = _block_path(self.root, block)
        if self.local:
            found = np.memmap(path, self.dtype, "r")
        else:
            with self.system.open_input_file(path) as f:
                found = np.frombuffer(f.read(), self.dtype)
        self.open[block] = found.reshape(-1, self.size)
        if len(self.open) > (OPEN_BLOCKS if self.local else HELD_BLOCKS):
            self.open.popitem(last=False)
        return self.open[block]

    def rows(self, blocks: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The vectors referred to; zeros where the block is -1. Each block is opened once for all its rows."""
        out = np.zeros((len(blocks), self.size), self.dtype)
        order = np.argsort(blocks, kind="stable")
        values, starts = np.unique(blocks[order], return_index=True)
        for block, mine in zip(values.tolist(), np.split(order, starts[1:])):
            if block >= 0:
                out[mine] = self.matrix(block)[places[mine]]
        return out


def fetch(df: DataFrame, blocks: Blocks, out: str = "vector", block: str = "block", place: str = "place") -> DataFrame:
    """Replace the reference in ``block`` and ``place`` by its vector; a NULL reference gives zeros.

    Row-local. The table's rows are handed on in slices of ``OUT_BYTES`` of numbers, whatever the vectors' size.
    """
    folder, size, dtype, kind = blocks.folder, blocks.size, KINDS[blocks.kind], blocks.kind
    others = [c for c in df.columns if c not in (block, place)]
    per_slice = max(1, OUT_BYTES // (size * dtype.itemsize))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder, size, dtype)
        for batch in batches:
            for done in range(0, batch.num_rows, per_slice):
                part = batch.slice(done, per_slice)
                n = part.num_columns - 2
                at = part.column(n).fill_null(-1).to_numpy(zero_copy_only=False)
                numbers = reader.rows(at, part.column(n + 1).fill_null(0).to_numpy(zero_copy_only=False))
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * size)
                vectors = pa.ListArray.from_arrays(ends, pa.array(numbers.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n)] + [vectors], names=[*others, out])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in others)
    rows = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{block}`").cast("bigint"), F.col(f"`{place}`").cast("int"))
    return rows.mapInArrow(read, f"{kinds}`{out}` array<{kind}>")
