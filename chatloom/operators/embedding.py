"""Placeholder spans, vector lookup, scatter, pooling, projection, loss."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.operators.blocks import Blocks, fetch
from chatloom.operators.joins import attach_by_frequency
from chatloom.registry import ModalitySpec

MAX_WEIGHT_BYTES = 1 << 30


def _span_starts(ids: Column, spec: ModalitySpec) -> Column:
    """First positions of a modality's spans: a fold over the positions that hold its code."""
    spots = F.filter(F.transform(ids, lambda x, i: F.when(x == spec.code, i)), lambda i: i.isNotNull())
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("starts"), F.lit(-2).alias("last"), F.lit(0).alias("run"))

    def step(a: Column, pos: Column) -> Column:
        run = F.when(pos == a["last"] + 1, a["run"] + 1).otherwise(F.lit(1))
        full = run == spec.width
        return F.struct(
            F.when(full, F.concat(a["starts"], F.array(pos - (spec.width - 1)))).otherwise(a["starts"]).alias("starts"),
            pos.alias("last"),
            F.when(full, F.lit(0)).otherwise(run).alias("run"),
        )

    return F.aggregate(spots, start, step, lambda a: a["starts"])


def find_spans(encoded: DataFrame, key: str, specs: Sequence[ModalitySpec], ids: str = "input_ids") -> DataFrame:
    """``(key, name, k, start, width)``: where the k-th item of a modality goes.

    Runs of one code are read from the left; a run holds floor(run / width) spans, so touching placeholders separate
    correctly and a cut-off rest of a run is no span. A sequence lies in one row, and so does the work: no shuffle.
    """
    per_spec = [
        F.struct(F.lit(s.name).alias("name"), _span_starts(F.col(ids), s).alias("starts"), F.lit(s.width).cast("bigint").alias("width"))
        for s in specs
    ]
    found = encoded.select(key, F.inline(F.array(*per_spec)))
    return found.select(key, "name", F.posexplode("starts").alias("k", "start"), "width").select(
        key, "name", F.col("k").cast("bigint").alias("k"), F.col("start").cast("bigint").alias("start"), "width"
    )


def embed_tokens(token_ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """Attach the columns of ``vectors`` (token_id, freq, ...), best a reference to each vector, to text positions.

    Placeholder positions (negative ids) stay without: they count as zero until an item is scattered there.
    """
    wanted = token_ids.withColumn("_text_id", F.when(F.col("token_id") >= 0, F.col("token_id")))
    return attach_by_frequency(wanted, vectors.withColumnRenamed("token_id", "_text_id"), "_text_id", "freq").drop("_text_id")


def scatter_items(spans: DataFrame, slots: DataFrame, key: str) -> DataFrame:
    """Fill the spans: slot s of the k-th item of a modality goes to position start + s.

    ``slots`` has (key, name, k, slot, payload...). A span whose item is missing yields one row per position with
    ``status = 'missing item'``; items without a span are ignored (see ``surplus_items``).
    """
    places = spans.select(key, "name", "k", "start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("width") - 1)).alias("slot"))
    filled = places.join(slots.withColumn("_found", F.lit(True)), [key, "name", "k", "slot"], "left")
    return filled.withColumn("pos", F.col("start") + F.col("slot")).withColumn(
        "status", F.when(F.col("_found"), "filled").otherwise("missing item")
    ).drop("_found", "start")


def input_references(embedded: DataFrame, filled: DataFrame, key: str, reference: Sequence[str] = ("block", "place")) -> DataFrame:
    """The sequence a model reads, by reference: ``(key, pos, kind, reference columns)`` for each position.

    ``embedded`` has every position with the reference of its text vector or NULLs (``embed_tokens``), ``filled`` those of
    items (``scatter_items``). A position is ``text``, ``item``, or ``zero`` where a placeholder has no item; the reference
    decides, no vector is looked at. Positions are unique on both sides, so the join is even.
    """
    items = filled.select(key, "pos", F.struct(*reference).alias("_item"))
    met = embedded.select(key, "pos", F.struct(*reference).alias("_text")).join(items, [key, "pos"], "left")
    text, item = F.col("_text")[reference[0]].isNotNull(), F.col("_item")[reference[0]].isNotNull()
    kind = F.when(text, "text").when(item, "item").otherwise("zero")
    chosen = F.when(text, F.col("_text")).otherwise(F.col("_item"))
    return met.select(key, "pos", kind.alias("kind"), *[chosen[r].alias(r) for r in reference])


def input_vectors(embedded: DataFrame, filled: DataFrame, key: str, blocks: Blocks, vector: str = "vector") -> DataFrame:
    """``(key, pos, kind, vector)``: ``input_references`` with the vectors fetched last, zeros where there is none."""
    return fetch(input_references(embedded, filled, key), blocks, vector)


def surplus_items(spans: DataFrame, slots: DataFrame, key: str) -> DataFrame:
    """Items no span asks for."""
    return slots.select(key, "name", "k").distinct().join(spans, [key, "name", "k"], "left_anti")


def masked_mean_pool(vectors: DataFrame, group: str, vector: str, mask: str) -> DataFrame:
    """``(group, vector)``: the mean of a group's unmasked vectors; all masked gives NaN in every dimension.

    One grouping of whole vectors; partial means combine in the tasks, so a group of any size ends as one row for each.
    A masked vector weighs next to nothing rather than nothing, which keeps the size of a group that has no other.
    """
    weight = F.when(F.col(mask) != 0, F.col(mask).cast("double")).otherwise(F.lit(1e-200))
    summed = vectors.groupBy(group).agg(
        Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")), weight).alias("_mean"), F.max(F.col(mask) != 0).alias("_any")
    )
    mean = vector_to_array("_mean")
    return summed.select(group, F.transform(mean, lambda x: F.when(F.col("_any"), x).otherwise(F.lit(float("nan")))).alias(vector))


def supervised_loss(positions: DataFrame, key: str, nll: DataFrame, by: list[str]) -> DataFrame:
    """Mean negative log likelihood over the positions whose next token is trained.

    ``positions`` has (key, pos, trained) and the columns ``by``; ``nll`` has (key, pos, nll). Position t predicts
    token t + 1, so the trained positions are simply moved one to the left; the first predicts nothing before it.
    One mean over all positions of a group, so long rows weigh more.
    """
    predicting = positions.filter(F.col("trained") & (F.col("pos") > 0)).select(key, *by, (F.col("pos") - 1).alias("pos"))
    return predicting.join(nll, [key, "pos"]).groupBy(*by).agg(
        F.avg("nll").alias("loss"), F.count(F.lit(1)).alias("positions")
    )


@dataclass(frozen=True)
class Projector:
    """Weights of one or several two-layer networks: per slot lists of (matrix, bias) layers, input to output."""

    layers: tuple[tuple[tuple[np.ndarray, np.ndarray], ...], ...]

    @property
    def nbytes(self) -> int:
        return sum(w.nbytes + b.nbytes for slot in self.layers for w, b in slot)


def erf(x: np.ndarray) -> np.ndarray:
    """Error function to double accuracy: 2/sqrt(pi) exp(-x^2) times the sum of 2^n x^(2n+1) / (2n+1)!!, which has no
    cancellation; from 6 on it is 1."""
    clipped = np.clip(x, -6.0, 6.0)
    square = clipped * clipped
    term, total = clipped.copy(), clipped.copy()
    n = 0
    while np.any(np.abs(term) > 1e-17 * np.abs(total)):
        n += 1
        term *= 2.0 * square / (2 * n + 1)
        total += term
    return 2.0 / math.sqrt(math.pi) * np.exp(-square) * total


def _gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1.0 + erf(x / math.sqrt(2.0)))


def apply_slot(layers: Sequence[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """One network on a batch of row vectors; exact GELU between the layers."""
    for number, (weight, bias) in enumerate(layers):
        x = (x if number == 0 else _gelu(x)) @ weight + bias
    return x


def project_vectors(df: DataFrame, key: str, vector: str, projector: Projector) -> DataFrame:
    """``(key, slot, projected)``: every vector through the network of each slot.

    One network per slot makes one vector fill several positions; a projector with a single slot maps patch vectors
    one to one. Matrix products need numpy, so Arrow batches go through ``mapInArrow``, whole batches at a time; the
    weights are model constants, broadcast once and refused above a fixed size. Vectors must not be NULL and all have
    the size of the first layer.
    """
    if projector.nbytes > MAX_WEIGHT_BYTES:
        raise ValueError(f"projector of {projector.nbytes} bytes is too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(projector.layers)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
            for slot, layers in enumerate(slots):
                y = apply_slot(layers, x)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * y.shape[1])
                columns = [batch.column(0), pa.array(np.full(n, slot, np.int64)), pa.ListArray.from_arrays(ends, pa.array(y.reshape(-1)))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "slot", "projected"])

    rows = df.select(F.col(key).alias("key"), vector)
    return rows.mapInArrow(run, f"key {kind}, slot bigint, projected array<double>").withColumnRenamed("key", key)
