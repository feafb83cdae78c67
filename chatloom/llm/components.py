"""Connected components by alternating large and small stars.

Links shrink towards each component's least node: a large star hangs a node's larger neighbours on its least neighbour, a
small star its smaller ones. The rounds are logarithmic in the length of a chain. A least neighbour is a combined
aggregate and is joined back, so a node with any number of links never is one task's group. Every round is written to the
shared folder; the driver sees two numbers of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.session import stage


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """links: (a, b), a > b, distinct."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links
    least = both.groupBy("a").agg(F.min("b").alias("_least")).select("a", F.least("a", "_least").alias("_least"))
    hung = both.join(least, "a")
    if larger:
        out = hung.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_least").alias("b"))
    else:
        out = hung.select(F.explode(F.array(F.struct("a", F.col("_least").alias("b")), F.struct(F.col("b").alias("a"), F.col("_least").alias("b")))).alias("l")).select("l.*")
    return out.filter(F.col("a") != F.col("b")).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node but the roots; ``links``: (a, b) in any order, repeats allowed.

    ``root`` is the least node of the component.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b"))
    now = stage(ordered.distinct(), "links")
    state = _state(now)
    while True:
        now = stage(_star(_star(now, True), False), "links")
        new = _state(now)
        if new == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new
