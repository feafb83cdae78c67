"""Reproducible randomness.

Every random choice is a function of (salt, row key), so a result does not depend on partitioning, retries or
lost executors. ``hash32`` is the first 8 hex digits of ``md5("salt:key")`` read as a number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_text(*keys: Column) -> Column:
    """Join several key columns into one text key."""
    return F.concat_ws(":", *[k.cast("string") for k in keys])


def order_key(key: Column, salt: str) -> Column:
    """Hex text whose sort order is a reproducible random permutation of the keys."""
    return F.md5(F.concat(F.lit(salt + ":"), key.cast("string")))


def hash32(key: Column, salt: str) -> Column:
    return F.conv(F.substring(order_key(key, salt), 1, 8), 16, 10).cast("bigint")


def hash60(key: Column, salt: str) -> Column:
    """The first 15 hex digits: wide enough for row numbers of any table."""
    return F.conv(F.substring(order_key(key, salt), 1, 15), 16, 10).cast("bigint")


def pick_row(key: Column, salt: str, n: Column | int) -> Column:
    """A row number in 0..n-1, as good as uniform for n up to some 2**50."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(hash60(key, salt), n.cast("bigint"))


def pick_index(key: Column, salt: str, n: Column | int) -> Column:
    """A number in 0..n-1 for a small n (a list, a handful of files); row numbers take ``pick_row``."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(hash32(key, salt), n.cast("bigint"))


def pick_one(key: Column, salt: str, choices: Sequence[str]) -> Column:
    """One of ``choices``; an entry listed twice is twice as likely."""
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (pick_index(key, salt, len(choices)) + 1).cast("int"))


def coin(key: Column, salt: str) -> Column:
    return pick_index(key, salt, 2) == 0


def bernoulli(key: Column, salt: str, rate: float) -> Column:
    return hash32(key, salt) < F.lit(int(rate * 2**32))


def shuffled(key: Column, salt: str, values: Sequence[str]) -> Column:
    """The given values as an array in an order drawn per row."""
    keyed = F.array(
        *[F.struct(order_key(F.concat_ws(":", key.cast("string"), F.lit(v)), salt).alias("o"), F.lit(v).alias("v")) for v in values]
    )
    return F.transform(F.array_sort(keyed), lambda s: s["v"])
