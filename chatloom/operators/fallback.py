"""Replace rows that cannot be encoded by the next row that can."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.ranking import is_dense, range_positions

BLOCK = 1 << 20


def fallback_map(flags: DataFrame, idx: str = "idx", ok: str = "ok", block: int = BLOCK) -> DataFrame:
    """``(idx, source)``: the row itself if it is ok, else the next ok row, wrapping round to the first.

    An index with gaps is numbered anew for the work, so that blocks hold as many rows as they should.
    """
    if is_dense(flags, idx):
        return _dense_map(flags, idx, ok, block)
    numbered = range_positions(flags.select(idx, ok), idx, "_number")
    found = _dense_map(numbered, "_number", ok, block)
    names = numbered.select("_number", idx)
    own = found.join(names, "_number")
    return own.join(names.select(F.col("_number").alias("source"), F.col(idx).alias("_name")), "source", "left").select(
        idx, F.col("_name").alias("source")
    )


def _dense_map(flags: DataFrame, idx: str, ok: str, block: int) -> DataFrame:
    """The map for row numbers without gaps.

    Works on the two narrow columns only. Rows are ranked within blocks of consecutive row numbers; what comes after
    a block is looked up in a table with one row per block. No ok row at all is an error.
    """
    good = F.when(F.col(ok), F.col(idx))
    keyed = flags.select(idx, good.alias("_good"), F.floor(F.col(idx) / F.lit(block)).cast("bigint").alias("_block"))
    blocks = keyed.groupBy("_block").agg(F.min("_good").alias("_first"))
    # Both windows run downwards: the smallest ok row seen so far is the next one. A frame that reaches forward to the
    # end would be evaluated anew for every row.
    downwards = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    following = blocks.select(
        "_block", F.coalesce(F.min("_first").over(downwards), F.min("_first").over(everywhere)).alias("_next")
    )
    onward = (
        Window.partitionBy("_block").orderBy(F.col(idx).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = keyed.withColumn("_inside", F.min("_good").over(onward))
    mapped = inside.join(F.broadcast(following), "_block").withColumn("source", F.coalesce("_inside", "_next"))
    return mapped.select(
        idx, F.when(F.col("source").isNull(), F.raise_error(F.lit("no row can be encoded"))).otherwise(F.col("source")).alias("source")
    )


def fallback_next(rows: DataFrame, idx: str = "idx", ok: str = "ok", block: int = BLOCK) -> DataFrame:
    """Same number of rows; a row that is not ok carries the payload of the row that replaces it.

    Good rows pass through untouched. Only replacements are joined, from the side of the (narrow) map, so a good row
    that replaces a long stretch of bad ones is a skewed key of the narrow side, which adaptive execution splits.
    """
    mapping = fallback_map(rows.select(idx, ok), idx, ok, block)
    good = rows.filter(F.col(ok)).drop(ok)
    replaced = mapping.filter(F.col(idx) != F.col("source"))
    # a left join, so that the error of a missing replacement is not optimized away with an empty good side
    filled = replaced.join(good.withColumnRenamed(idx, "source"), "source", "left")
    return good.withColumn("source", F.col(idx)).unionByName(filled)
