"""Array arithmetic on samples and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_mono(samples: Column) -> Column:
    """Mean over the channels of an array of sample frames."""
    return F.transform(
        samples,
        lambda channels: F.aggregate(channels, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
        / F.size(channels).cast("double"),
    )


def as_frames(flat: Column, channels: int) -> Column:
    """Interleaved samples to an array of frames with ``channels`` values each."""
    n = (F.size(flat) / channels).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(flat, i * channels + 1, channels))


def checksum(vector: Column) -> Column:
    """Position-weighted integer digest of a vector at six decimals; the same in any engine."""
    micro = F.transform(
        vector, lambda v, i: F.floor(v.cast("double") * 1e6 + 0.5).cast("bigint") * (i + 1).cast("bigint")
    )
    return F.aggregate(micro, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
