import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.operators import blocks, embedding


def table(spark, n=500, size=6):
    values = [(i, [float(i), -float(i), *[i / 7] * (size - 2)]) for i in range(n)]
    return spark.createDataFrame(values, "vec_id long, v array<double>").repartition(5)


@pytest.mark.parametrize("block_bytes, out_bytes", [(64 << 20, 16 << 20), (7 * 48, 200)])
def test_vectors_come_back(spark, monkeypatch, block_bytes, out_bytes):
    """Whatever the sizes of blocks and slices; repeated and missing references too."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(blocks, "OUT_BYTES", out_bytes)
    stored = blocks.store_vectors(table(spark), ["vec_id"], "v", 6, "double")
    assert stored.index.columns == ["vec_id", "block", "place"] and stored.index.count() == 500
    wanted = spark.range(900).select(F.col("id"), (F.col("id") * 7 % 600).alias("vec_id"), F.lit("x").alias("block_name"))
    got = blocks.fetch(wanted.join(stored.index, "vec_id", "left"), stored).collect()
    assert len(got) == 900 and got[0].__fields__ == ["vec_id", "id", "block_name", "vector"]
    for r in got:
        i = r["vec_id"]
        assert r["vector"] == ([float(i), -float(i), *[i / 7] * 4] if i < 500 else [0.0] * 6)


def test_float_vectors_and_two_sets_in_one_folder(spark):
    a = blocks.store_vectors(table(spark, 20, 3), ["vec_id"], "v", 3)
    b = blocks.store_vectors(table(spark, 20, 3).withColumn("v", F.transform("v", lambda x: -x)), ["vec_id"], "v", 3, beside=a)
    both = a.index.unionByName(b.index)
    sums = blocks.fetch(both, a).groupBy("vec_id").agg(F.sum(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)).alias("s"))
    assert {r["s"] for r in sums.collect()} == {0.0}
    row = blocks.fetch(a.index.filter("vec_id = 5"), a).first()
    assert row["vector"] == [5.0, -5.0, float(np.float32(5 / 7))]
    with pytest.raises(ValueError):
        blocks.store_vectors(table(spark), ["vec_id"], "v", 6, beside=a)


@pytest.mark.parametrize("bad", [None, [1.0]])
def test_a_bad_vector_is_named(spark, bad):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (77, bad)], "vec_id long, v array<double>")
    with pytest.raises(Exception, match="no vector of 2 numbers: .77"):
        blocks.store_vectors(df, ["vec_id"], "v", 2)


def test_no_rows(spark):
    stored = blocks.store_vectors(table(spark).limit(0), ["vec_id"], "v", 6)
    assert stored.index.count() == 0 and blocks.fetch(stored.index, stored).count() == 0


def test_input_vectors_move_no_numbers(spark):
    """Everything after the vectors were stored shuffles references; the numbers are read in the last, row-local step."""
    stored = blocks.store_vectors(table(spark), ["vec_id"], "v", 6, "double")
    ids = spark.range(300).select(F.lit(0).alias("row"), F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, -9).otherwise(F.col("id")).alias("token_id"))
    entries = stored.index.select(F.col("vec_id").alias("token_id"), F.lit(1).alias("freq"), "block", "place")
    slots = spark.range(0, 200, 3).select(F.lit(0).alias("row"), F.col("id").alias("pos"), (F.col("id") + 1).alias("vec_id")).join(stored.index, "vec_id")
    rows = embedding.input_vectors(embedding.embed_tokens(ids, entries), slots, "row", stored)
    plan = rows._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.index("MapInArrow") < text.index("Exchange")  # above every exchange
    for r in rows.collect():
        p = r["pos"]
        kind, i = ("text", p) if p % 3 else ("item", p + 1) if p < 200 else ("zero", None)
        assert (r["kind"], r["vector"][0]) == (kind, float(i) if i is not None else 0.0)
