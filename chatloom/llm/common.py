"""What several operators share: the word pattern, positions without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.ranking import in_ranges

WORD = r"[^\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def count_words(text: str | Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("bigint")


def positions(df: DataFrame, order: Sequence[Column], out: str, name: str) -> DataFrame:
    """0-based position of every row in ``order``.

    Each range is ranked on its own; the ranges' first positions are a running sum over one row for each range
    (as many as shuffle partitions), which is also all that is broadcast.
    """
    ranged = in_ranges(df, order, name)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("bigint").alias("_first"))
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.join(F.broadcast(first), "_range")
        .withColumn(out, F.col("_first") + F.row_number().over(inside) - 1)
        .drop("_range", "_first")
    )


def text_print(text: str | Column) -> Column:
    """The XXH64 of the whole text, by which rows are found again."""
    return F.xxhash64(whole(text))


def rows_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose key and ``text_print`` are in ``wanted`` (_key, _print), one of those that repeat both."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"), F.col(f"`{key}`").alias("_k"), text_print(f"`{text}`").alias("_p"))
    same = F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_p") == F.col("_print"))
    rows = rows.join(wanted.distinct().hint("merge"), same, "left_semi")
    rest = [F.col("_in").getField(c) for c in docs.columns if c not in (key, text)]
    nth = F.row_number().over(Window.partitionBy("_k", "_p").orderBy(F.hash(*rest) if rest else F.lit(0)))
    return rows.withColumn("_nth", nth).filter("_nth = 1").select("_in.*")
