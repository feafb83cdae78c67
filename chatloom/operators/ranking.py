"""Global positions without a global sort.

A window without PARTITION BY would rank all rows in one task. Here rows fall into many ordered buckets, each bucket
is ranked on its own, and the bucket's first position comes from a running sum over the (bounded) list of bucket
counts. Hash buckets are even whatever the keys look like; sorted ranges come from Spark's range partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.hashing import key_text, order_key
from chatloom.session import stage

HASH_DIGITS = 5  # at most 2**20 buckets: some 10**5 rows in each at 10**11 rows


def _positions(
    df: DataFrame, bucket: Column, order: Sequence[Column], out: str, first_n: int | None = None
) -> DataFrame:
    keyed = df.withColumn("_bucket", bucket)
    # first pass: only the bucket expression's columns are read, counts are combined before the shuffle
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).cast("bigint").alias("_offset"))
    if first_n is not None:
        offsets = offsets.filter(F.col("_offset") < first_n)
    within = Window.partitionBy("_bucket").orderBy(*order)
    ranked = keyed.join(F.broadcast(offsets), "_bucket").withColumn(
        out, F.col("_offset") + F.row_number().over(within) - 1
    )
    if first_n is not None:
        ranked = ranked.filter(F.col(out) < first_n)
    return ranked.drop("_bucket", "_offset")


def hash_positions(
    df: DataFrame,
    keys: Sequence[str],
    salt: str,
    out: str = "position",
    digits: int = HASH_DIGITS,
    first_n: int | None = None,
) -> DataFrame:
    """0-based position of every row in a reproducible random order of the row key ``keys`` (must be unique).

    With ``first_n`` only the rows in front are kept, and buckets that lie wholly behind them never reach the window.
    Small buckets keep each window group in memory; at most 16**digits (bucket, offset) pairs of numbers are broadcast.
    """
    key = key_text(*[F.col(k) for k in keys])
    shuffled = order_key(key, salt)
    bucket = F.conv(F.substring(shuffled, 1, digits), 16, 10).cast("int")
    return _positions(df, bucket, [shuffled, key], out, first_n)


def in_ranges(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Stage ``df`` in sorted ranges of ``order``, as many as shuffle partitions; ``_range`` numbers them.

    The number is written with the rows, so later plans and repeated tasks see the same ranges. Rows with equal keys
    stay together: end the order with a unique column where one key may be hot.
    """
    return stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)


def range_positions(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """0-based dense index in the order of a unique key of any sortable type.

    Each range is ranked on its own; what is broadcast has one row for each range, whatever the keys look like.
    """
    ranged = in_ranges(df, [F.col(key)], "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    first = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).cast("bigint").alias("_offset"))
    within = Window.partitionBy("_range").orderBy(key)
    ranked = ranged.join(F.broadcast(first), "_range").withColumn(out, F.col("_offset") + F.row_number().over(within) - 1)
    return ranked.select(*[c for c in df.columns if c != out], out)


def is_dense(df: DataFrame, key: str) -> bool:
    """True if the key counts 0..n-1 (given that it is unique)."""
    row = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    return row["n"] == 0 or (row["lo"] == 0 and row["hi"] == row["n"] - 1)


def dense_index(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """Use ``key`` as row index if it is dense already, else rank by it."""
    return df.withColumn(out, F.col(key)) if is_dense(df, key) else range_positions(df, key, out)
