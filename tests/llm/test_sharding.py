import zlib
from collections import defaultdict

import pytest
from fixtures import edge_docs, edge_rows, no_docs
from pyspark.sql import functions as F

from chatloom.llm.sharding import shard_by_bytes


def test_edges(spark):
    rows = edge_rows()
    got = shard_by_bytes(edge_docs(spark), shards=7).collect()
    assert len(got) == len(rows)
    size = {t: len((t or "").encode()) + 16 for t in {r[1] for r in rows}}
    slots = defaultdict(list)
    for r in got:
        assert r["size"] == size[r["text"]] and r["law"] == "bytes" and r["grown_shard"] is None
        assert r["key"] == "key" and r["_t"] == "_t" and 0 <= r["shard"] < 7
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(zlib.crc32((r["text"] or "").encode()) for r in got) == sorted(zlib.crc32((r[1] or "").encode()) for r in rows)


@pytest.mark.parametrize("partitions", [1, 5])
def test_bytes_are_even_and_copies_together(spark, partitions):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.pmod(F.xxhash64(F.col("id") - F.col("id") % 2), F.lit(900)) + 1).cast("int")).alias("text"))
    docs = docs.withColumn("text", F.concat("text", (F.col("doc_id") - F.col("doc_id") % 2).cast("string"))).repartition(partitions)
    rows = shard_by_bytes(docs, shards=40, tolerance=0.01)
    by = rows.groupBy("shard").agg(F.sum("size").alias("b")).collect()
    mean = sum(r["b"] for r in by) / 40
    assert len(by) == 40 and all(abs(r["b"] - mean) <= 0.021 * mean for r in by)
    assert rows.groupBy("text").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0


def test_a_hot_text_is_cut(spark):
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 6_000, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    by = shard_by_bytes(docs, shards=10).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    mean = sum(r["b"] for r in by) / 10
    assert len(by) == 10 and all(abs(r["b"] - mean) <= 0.02 * mean and r["m"] == r["n"] - 1 for r in by)


def test_reruns_and_few_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id bigint, text string")
    once = sorted(shard_by_bytes(docs).select("doc_id", "shard", "slot").collect())
    assert once == sorted(shard_by_bytes(docs.repartition(3)).select("doc_id", "shard", "slot").collect())
    assert len({r["shard"] for r in once}) == 3
    assert shard_by_bytes(no_docs(spark)).count() == 0
