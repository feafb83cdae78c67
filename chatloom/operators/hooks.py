"""User code of a modality, run in Arrow batches where the rows are.

A hook is called with at most ``HOOK_BYTES`` of items at a time, whatever a row holds. A modality's ``setup`` (loading a
model, say) runs once in each Python worker, not once a task or batch. ``profile`` asks for executors with what the code
needs, such as accelerators.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chatloom.registry import ModalitySpec

HOOK_BYTES = 16 << 20


def _states() -> dict:
    """What this worker has set up. Code that is sent to a worker by value has globals of its own for each task; what is
    entered among the loaded modules stays."""
    return sys.modules.setdefault("_chatloom_worker_states", types.ModuleType("_chatloom_worker_states")).__dict__


def bound_hook(spec: ModalitySpec, hook: Callable) -> Callable:
    """The hook with its worker's state, if the modality has a set-up."""
    if spec.setup is None:
        return hook
    states, known = _states(), f"{spec.name} {spec.token}"
    if known not in states:
        states[known] = spec.setup()
    return lambda items: hook(states[known], items)


def slices(batch: pa.RecordBatch, column: int, most: int = HOOK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose values in ``column`` have about ``most`` bytes, one row at least."""
    n = max(1, batch.num_rows * most // max(most, batch.column(column).nbytes))
    for at in range(0, batch.num_rows, n):
        part = batch.slice(at, n)
        if part.num_rows > 1 and part.column(column).nbytes > 2 * most:  # rows of very different sizes
            yield from slices(part, column, most)
        else:
            yield part


def preprocess_rows(df: DataFrame, key: str, spec: ModalitySpec, value_type: T.DataType, profile: ResourceProfile | None = None) -> DataFrame:
    """``(key, value, error)``: the item list of every row through the modality's ``preprocess`` hook.

    The hook takes the item lists of a batch and returns one value per list; without a hook the list itself is the
    value. A row without a list (NULL) fails, and so does a row the hook raises on: such a batch is run again row by
    row, so that only the bad rows are marked.
    """
    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType), T.StructField("value", value_type), T.StructField("error", T.StringType())]
    )
    kind, missing = to_arrow_type(value_type), f"no {spec.data_key}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hook = bound_hook(spec, spec.preprocess) if spec.preprocess else None

        def all_of(lists: list) -> list[tuple]:
            if hook is None:
                return [(v, None) for v in lists]
            values = hook(lists) if lists else []
            if len(values) != len(lists):
                raise ValueError(f"{len(values)} values for {len(lists)} lists")
            pa.array(values, kind)
            return [(v, None) for v in values]

        def one(items: list) -> tuple:
            try:
                return all_of([items])[0]
            except Exception as e:  # noqa: BLE001 - a bad row must not stop the others
                return None, f"{type(e).__name__}: {e}"

        for batch in (s for b in batches for s in slices(b, 1)):
            lists = batch.column(1).to_pylist()
            present = [v for v in lists if v is not None]
            try:
                done = iter(all_of(present))
            except Exception:  # noqa: BLE001
                done = iter([one(v) for v in present])
            values, errors = zip(*[(None, missing) if v is None else next(done) for v in lists]) if lists else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, kind), pa.array(errors, pa.string())], names=[key, "value", "error"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{spec.data_key}`")).mapInArrow(run, schema, profile=profile)


def encode_items(items: DataFrame, key: str, spec: ModalitySpec, value: str = "value", profile: ResourceProfile | None = None) -> DataFrame:
    """``(key, name, k, vector)``: one vector per item through the modality's ``encode`` hook.

    ``items`` has (key, k, value). The hook returns lists of numbers, or one numpy array of them, which goes to Arrow as it
    is. Without a hook, join a table of precomputed vectors instead.
    """
    if spec.encode is None:
        raise ValueError(f"modality {spec.name} has no encode hook")
    schema = T.StructType(
        [
            T.StructField(key, items.schema[key].dataType),
            T.StructField("k", T.LongType()),
            T.StructField("vector", T.ArrayType(T.FloatType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hook = bound_hook(spec, spec.encode)
        for batch in (s for b in batches for s in slices(b, 2)):
            if not batch.num_rows:
                continue
            made = hook(batch.column(2).to_pylist())
            if len(made) != batch.num_rows:
                raise ValueError(f"{len(made)} vectors for {batch.num_rows} items")
            if isinstance(made, np.ndarray):
                ends = np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]
                vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(made, np.float32).reshape(-1)))
            else:
                sizes = np.fromiter((len(v) for v in made), np.int32, len(made))
                flat = np.concatenate([np.asarray(v, np.float32) for v in made])
                vectors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors], names=[key, "k", "vector"])

    rows = items.select(F.col(f"`{key}`"), F.col("k").cast("bigint").alias("k"), F.col(f"`{value}`"))
    out = rows.mapInArrow(run, schema, profile=profile)
    return out.select(key, F.lit(spec.name).alias("name"), "k", "vector")
