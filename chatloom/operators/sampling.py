"""Shuffle, sample, draw: all reproducible, none through the driver or a single task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.functions.hashing import bernoulli, hash32, key_text, pick_index, pick_row
from chatloom.operators.ranking import hash_positions
from chatloom.session import stage


def shuffle_dataset(df: DataFrame, keys: Sequence[str], salt: str = "shuffle", out: str = "position") -> DataFrame:
    """Random order as a ``position`` column; write with ``repartitionByRange(position)`` for ordered files."""
    return hash_positions(df, keys, salt, out)


def sample_at_most(df: DataFrame, keys: Sequence[str], n: int, salt: str = "sample") -> DataFrame:
    """Exactly ``n`` rows without replacement, or all rows if there are no more than ``n``.

    The threshold comes from bucket counts over the key alone; there is no top-n heap, which for large ``n`` would
    gather whole rows in one task.
    """
    return hash_positions(df, keys, salt, "_position", first_n=n).drop("_position")


def sample_rate(df: DataFrame, key: Column, rate: float, salt: str = "rate") -> DataFrame:
    """Keep each row with the given probability."""
    return df.filter(bernoulli(key, salt, rate))


def accept_until(
    source: DataFrame,
    keys: Sequence[str],
    build: Callable[[DataFrame], DataFrame],
    n: int,
    salt: str = "accept",
    out: str = "position",
) -> DataFrame:
    """Build rows in random order, skip rejects, stop at ``n`` accepted.

    ``build`` turns source rows into accepted rows and keeps the key columns. Only a prefix of the random order is
    built - rows whose hash lies below a threshold - and the threshold grows until enough rows were accepted or the
    source is used up. So the costly build runs over about ``n`` rows, not over the whole source, and the result is
    exactly the first ``n`` accepted rows whatever thresholds were tried.
    """
    total = source.count()
    key = key_text(*[F.col(k) for k in keys])
    share = min(1.0, 1.25 * n / max(total, 1))
    while True:
        front = source if share >= 1.0 else source.filter(hash32(key, salt) < int(share * 2**32))
        accepted = stage(build(front), "accepted")
        found = accepted.count()
        if found >= n or share >= 1.0:
            return hash_positions(accepted, keys, salt, out, first_n=n)
        share = min(1.0, share * max(2.0, 1.25 * n / max(found, 1)))


def drawn_row(salt: str, rows: int) -> Column:
    """The row that an attempt (``shard``, ``attempt``) draws."""
    return pick_row(key_text(F.col("shard"), F.col("attempt")), salt, rows)


def next_attempts(open_shards: DataFrame, rows: int, salt: str = "draw") -> DataFrame:
    """``shard, attempt, idx``: the attempts ``first`` to ``last`` - 1 of each shard and the row each draws."""
    made = open_shards.select("shard", F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("attempt"))
    return made.withColumn("idx", drawn_row(salt, rows))


def attempts(spark: SparkSession, rows: int, shards: int, first: int, last: int, salt: str = "draw") -> DataFrame:
    """The same attempts of every shard."""
    return next_attempts(spark.range(shards).select(F.col("id").alias("shard"), _long(first).alias("first"), _long(last).alias("last")), rows, salt)


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def draw_with_retry(
    spark: SparkSession,
    rows: int,
    build: Callable[[DataFrame], DataFrame],
    shards: int,
    quota: int,
    salt: str = "draw",
    max_factor: int = 64,
    start: int = 1,
) -> DataFrame:
    """Every shard draws row numbers with replacement until ``quota`` draws were accepted.

    ``build`` receives ``(shard, attempt, idx)`` and returns the accepted attempts with their payload. It is given every
    attempt once: a round asks for the next attempts of the shards that are still open, as many as their own acceptance so
    far makes likely to fill them; the first asks for ``start`` times the quota, more than once where asking costs nothing.
    The result, the first ``quota`` accepted attempts of each shard, does not depend on how rounds were cut. A source that
    rejects nearly everything raises an error after ``quota * max_factor`` attempts instead of looping for ever. Keep the quota of a shard moderate (some 10**5) and scale the number of shards.
    """
    if rows < 1:
        raise ValueError("nothing to draw from")
    most = quota * max_factor
    state = spark.range(shards).select(F.col("id").alias("shard"), _long(0).alias("first"), _long(quota * start).alias("last"))
    accepted = None
    while True:
        found = stage(build(next_attempts(state, rows, salt)), "draws")
        accepted = found if accepted is None else accepted.unionByName(found)
        have = accepted.groupBy("shard").agg(F.count(F.lit(1)).alias("_have"))
        tried, got = F.col("last"), F.coalesce(F.col("_have"), F.lit(0))
        likely = F.ceil(F.lit(1.25) * (quota - got) * tried / F.greatest(got, F.lit(1))).cast("bigint")
        after = F.least(tried + F.least(likely, 4 * tried), F.lit(most))
        state = state.join(have, "shard", "left").filter(got < quota).select("shard", tried.alias("first"), after.alias("last"))
        state = stage(state, "open_shards")
        counts = state.agg(F.count(F.lit(1)).alias("open"), F.count_if(F.col("first") >= most).alias("stuck")).first()
        if counts["stuck"]:
            raise RuntimeError(f"{counts['stuck']} of {shards} shards not filled after {most} attempts each")
        if not counts["open"]:
            order = Window.partitionBy("shard").orderBy("attempt")
            slot = (F.row_number().over(order) - 1).cast("bigint")
            return accepted.withColumn("slot", slot).filter(F.col("slot") < quota)


def draw_k_rows(examples: DataFrame, example: str, rows: int, max_k: int, salt: str = "k") -> DataFrame:
    """For each example k ~ U[1, max_k] distinct row numbers in drawn order, as rows ``(example, slot, idx)``.

    The i-th draw is a number below rows - i and stands for the so-maniest row not drawn before, so every ordered choice
    of k rows is equally likely and no draw is ever repeated. All of it happens inside the row.
    """
    if rows < max_k:
        raise ValueError(f"cannot draw {max_k} distinct rows from {rows}")
    key = F.col(example)
    k = (pick_index(key, salt + ".count", max_k) + 1).cast("int")

    def draw(drawn: Column, i: Column) -> Column:
        number = pick_row(key_text(key, i), salt + ".row", F.lit(rows) - i)
        skipped = F.aggregate(F.array_sort(drawn), number, lambda v, taken: F.when(taken <= v, v + 1).otherwise(v))
        return F.array_append(drawn, skipped)

    chosen = F.aggregate(F.sequence(F.lit(0), k - 1), F.array().cast("array<bigint>"), draw)
    return examples.select(example, F.posexplode(chosen).alias("slot", "idx")).withColumn(
        "slot", F.col("slot").cast("bigint")
    )
