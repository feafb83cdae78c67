"""Evaluate costly columns exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` whose expressions are not copied into later filters and projections.

    The optimizer merges neighbouring projections and pushes filters below them by substituting expressions, which
    evaluates a tokenizer or a fold again for every mention, and inside a lambda again for every element. The
    columns of a generator are not substituted, so a one-row generator keeps the value.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
