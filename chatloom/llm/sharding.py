"""Shards of equal bytes by a histogram sort.

Rows are ordered by (hash of the text, hash of key and text), so copies of a text are neighbours and a text of any
weight can still be cut. The splitters between shards are found without sampling and without sorting: each round counts
the exact bytes below 256 candidate boundaries inside every splitter's interval and narrows the interval to the candidate
pair around the wanted byte, until a boundary lies within the tolerance. Rows are exchanged once, after that.

Everything is DataFrame functions. The driver sees one histogram of at most 256 x (shards - 1) sums for each round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import whole
from chatloom.session import stage

STEP = 8  # bits by which a round narrows an interval
LOWEST = -(1 << 63)
SUB_BITS = 10  # each shard is numbered in 2**SUB_BITS parts side by side


@dataclass
class _Search:
    """A splitter on its way: bytes ``below`` its interval, ``text`` once all bits of the first hash are fixed."""

    goal: float
    below: int = 0
    prefix: int = 0
    text: int | None = None
    found: tuple[int, int] | None = None
    done: bool = False


def _round(sized: DataFrame, open_: list[_Search], bits: int, inside: bool) -> dict[tuple, list[tuple[int, int, int]]]:
    """Exact (bin, bytes, rows) for the open intervals; a bin is the next ``STEP`` bits."""
    key = F.col("_u") if inside else F.col("_t")
    rows = sized
    if inside:
        rows = rows.filter(F.col("_t").isin(sorted({s.text for s in open_})))
    if bits:
        rows = rows.filter(F.shiftright(key, 64 - bits).isin(sorted({s.prefix for s in open_})))
    counted = (
        rows.groupBy((F.col("_t") if inside else F.lit(None).cast("bigint")).alias("text"), F.shiftright(key, 64 - bits - STEP).alias("bin"))
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    wanted: dict[tuple, list] = {}
    for r in counted:
        parent = r["bin"] >> STEP if bits else 0
        wanted.setdefault((r["text"], parent), []).append((r["bin"], r["bytes"], r["n"]))
    return {k: sorted(v) for k, v in wanted.items()}


def _edge(search: _Search, bin_: int, bits: int, inside: bool) -> tuple[int, int]:
    """The first key of a bin; past the last row of a text the first key of the next one."""
    start = bin_ << (64 - bits - STEP)
    if not inside:
        return start, LOWEST
    return (search.text, start) if start < 1 << 63 else (search.text + 1, LOWEST)


def find_splitters(sized: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """First key (text hash, row hash) of the shards 1, 2, ...; ``sized`` has ``_t``, ``_u`` and ``size``."""
    total = sized.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    searches = [_Search(goal=total * i / shards) for i in range(1, shards)]
    if not total:
        return []
    for inside in (False, True):
        for bits in range(0, 64, STEP):
            open_ = [s for s in searches if not s.done]
            if not open_:
                break
            found = _round(sized, open_, bits, inside)
            for s in open_:
                below = s.below
                for bin_, size, n in found[(s.text if inside else None, s.prefix)]:
                    if below + size < s.goal:
                        below += size
                        continue
                    left, right = s.goal - below, below + size - s.goal
                    last = inside and bits + STEP == 64
                    if min(left, right) <= slack or n == 1 or last:
                        s.done = True
                        s.found = _edge(s, bin_ if left <= right else bin_ + 1, bits, inside)
                    else:
                        s.below, s.prefix = below, bin_
                    break
        for s in searches:
            if not s.done:  # one text around the wanted byte: cut it between its rows
                s.text, s.prefix = s.prefix, 0
    return sorted(s.found for s in searches)


def _shard_of(splitters: list[tuple[int, int]]) -> Column:
    reachable = [s for s in splitters if s[0] < 1 << 63]  # no row lies behind the others
    if not reachable:
        return F.lit(0)
    firsts = F.array(*[F.struct(F.lit(t).cast("bigint").alias("t"), F.lit(u).cast("bigint").alias("u")) for t, u in reachable])
    row = F.struct(F.col("_t").alias("t"), F.col("_u").alias("u"))
    return F.size(F.filter(firsts, lambda first: first <= row))


def shard_by_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, extra: int = 16, tolerance: float = 0.005) -> DataFrame:
    """All columns of ``docs`` with ``size``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    ``size``: UTF-8 bytes of the text (NULL: none) plus ``extra``. A shard's bytes differ from total / shards by at most
    ``tolerance`` of that, or by one row where rows are larger. Copies of a text stay in one shard unless keeping them
    together would break the tolerance. ``slot`` counts 0, 1, ... within a shard. ``law`` is "bytes"; ``grown_shard`` is
    NULL, as this law moves rows between all shards when one is added. NULL keys are ordinary keys; rows that repeat key
    and text have one place in the order and share a shard. An empty table gives no rows, a table with fewer rows than
    shards leaves shards empty. Columns of ``docs`` with the names of the new ones are replaced.
    """
    made = {"size", "law", "shard", "slot", "grown_shard"}
    t = F.xxhash64(whole(F.col(f"`{text}`")))
    u = F.xxhash64(F.lit("row"), F.col(f"`{key}`"), t)
    size = (F.octet_length(whole(F.col(f"`{text}`"))) + extra).cast("bigint")
    sized = stage(docs.select(t.alias("_t"), u.alias("_u"), size.alias("size")), "sized")
    shard = _shard_of(find_splitters(sized, shards, tolerance)).cast("int")
    sub = F.shiftrightunsigned(F.col("_u"), 64 - SUB_BITS).cast("int")

    counts = sized.select(shard.alias("shard"), sub.alias("_sub")).groupBy("shard", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))

    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"), size.alias("size"), t.alias("_t"), u.alias("_u"))
    within = Window.partitionBy("shard", "_sub").orderBy("_t", "_u")
    return (
        placed.withColumn("shard", shard)
        .withColumn("_sub", sub)
        .withColumn("_i", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "_sub"])
        .select(
            *[F.col("_in").getField(c).alias(c) for c in docs.columns if c not in made],
            "size",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("_first") + F.col("_i")).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
