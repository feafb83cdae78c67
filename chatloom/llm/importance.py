"""Importance resampling towards a target distribution.

Features are the runs of 1 to n words of a text, hashed into buckets. A bucket's gain is the logarithm of how much likelier
it is in the target than in the documents; a document's weight is the sum of its features' gains. A part of the long enough
documents is drawn without replacement in proportion to exp(weight), by the largest of weight plus Gumbel noise (both in
thousandths), where the noise is a hash of the key: reruns draw the same.

1. Every task interns the n-grams of its batches (``ngram_table``) and adds the table's counts to one number for each
   bucket; these combine in Spark. Gains are computed from at most as many rows as there are buckets.
2. In a second pass the slot of every occurrence gathers its gain, and rows sum up.
3. Scores are ranked in sorted ranges of narrow rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import positions, whole
from chatloom.llm.ngram_table import Grams, Table, grams, intern
from chatloom.session import stage

BUCKETS = 10_000


def bucket_slots(g: Grams, table: Table, buckets: int) -> np.ndarray:
    """The bucket of each used slot: CRC-32 of the bytes, computed once however often they occur."""
    found = np.zeros(len(table.holder), np.int64)
    view = memoryview(g.bytes)
    used = np.flatnonzero(table.holder >= 0)
    starts, sizes = g.start[table.holder[used]], g.size[table.holder[used]]
    found[used] = [zlib.crc32(view[a : a + n]) % buckets for a, n in zip(starts.tolist(), sizes.tolist())]
    return found


def _counter(buckets: int, most: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for batch in batches:
            # the two sides come from different files, so a batch is nearly always of one
            for side in np.unique(batch.column(0).to_numpy(zero_copy_only=False)):
                texts = batch.column(1).filter(pa.compute.equal(batch.column(0), pa.scalar(side, pa.int32())))
                for _, _, _, blocks in grams(texts, most):
                    for g in blocks:
                        table = intern(g)
                        np.add.at(sums[side], bucket_slots(g, table, buckets), table.count)
        used = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[0, used]), pa.array(sums[1, used])], names=["bucket", "s", "t"])

    return count


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most: int = 1) -> list[int]:
    """The gain of each bucket from all texts of both tables (one column ``text`` each, no NULLs), in thousandths."""
    sides = docs.select(F.lit(0).alias("side"), "text").unionByName(target.select(F.lit(1).alias("side"), "text"))
    counted = sides.mapInArrow(_counter(buckets, most), "bucket int, s bigint, t bigint")
    found = counted.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # a row for each bucket
    s, t = [0] * buckets, [0] * buckets
    for r in found:
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    own, wanted = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log((t[b] + 1.0) * own / ((s[b] + 1.0) * wanted))) for b in range(buckets)]


def _weigher(gains: list[int], most: int) -> Callable:
    gain = np.array(gains, np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, n, own_words, blocks in grams(batch.column(1), most):
                words[row : row + n] = own_words
                for g in blocks:
                    table = intern(g)
                    of_slot = gain[bucket_slots(g, table, len(gain))]
                    np.add.at(weight, g.row + row, of_slot[table.slot])
                    features[row : row + n] += np.bincount(g.row, minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["key", "n_words", "n_features", "weight"])

    return weigh


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    most: int = 1,
    buckets: int = BUCKETS,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """One row for each input row: ``key``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` (1, 2, ... of those
    drawn in the order of score, else NULL).

    ``percent`` of the rows with at least ``least_words`` words are drawn, rounded down; ties go to the smaller key, NULL
    keys last. A NULL text is empty: no features, weight 0. A NULL key's noise is that of an empty key. Rows that repeat a
    key are ranked one after the other. Empty tables give no rows; an empty target favours rare buckets. Columns other
    than key and text are not read.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), whole(F.col(f"`{text}`")).alias("text"))
    gains = bucket_gains(rows, target.select(whole(F.col(f"`{target_text}`")).alias("text")), buckets, most)
    kind = rows.schema["key"].dataType.simpleString()
    weighed = rows.mapInArrow(_weigher(gains, most), f"key {kind}, n_words bigint, n_features bigint, weight bigint")
    drawn_by = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn_by, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    scored = stage(weighed.withColumn("score", F.col("weight") + noise), "scores")
    enough = F.col("n_words") >= least_words
    n = scored.filter(enough).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("key"), F.col("n_features"), F.col("weight")]
    ranked = positions(scored.filter(enough), order, "_at", "ranks")
    ranked = ranked.withColumn("rank", F.when(F.col("_at") < n, F.col("_at") + 1)).drop("_at")
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).withColumnRenamed("key", key)
