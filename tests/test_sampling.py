import hashlib

import pytest
from pyspark.sql import functions as F

from chatloom.operators import ranking, sampling
from chatloom.operators.merging import merge_datasets


def order(keys, salt):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{salt}:{k}".encode()).hexdigest(), str(k)))


def test_positions_equal_a_global_sort(spark):
    want = order(range(500), "s")
    for n in (1, 4, 16):
        got = ranking.hash_positions(spark.range(500).repartition(n), ["id"], "s", digits=1).orderBy("position").collect()
        assert [r["id"] for r in got] == want and [r["position"] for r in got] == list(range(500))


def test_first_n_keeps_the_front(spark):
    for n in (0, 1, 99, 499, 500, 900):
        got = sampling.sample_at_most(spark.range(500), ["id"], n, "s").collect()
        assert sorted(r["id"] for r in got) == sorted(order(range(500), "s")[:n])


def test_range_positions(spark):
    df = spark.range(300).select((F.col("id") * 7 - 100).alias("k"))
    got = ranking.range_positions(df.repartition(5), "k").orderBy("idx").collect()
    assert [(r["k"], r["idx"]) for r in got] == [(i * 7 - 100, i) for i in range(300)]
    assert not ranking.is_dense(df, "k") and ranking.is_dense(spark.range(5), "id")
    assert [r["idx"] for r in ranking.dense_index(spark.range(5), "id").orderBy("id").collect()] == list(range(5))


def test_accept_until_equals_a_scan(spark):
    built = []

    def build(rows):
        built.append(rows)
        return rows.filter(F.col("id") % 7 == 0)

    want = [i for i in order(range(1000), "accept") if i % 7 == 0]
    for n in (1, 20, 140, 5000):
        got = sampling.accept_until(spark.range(1000), ["id"], build, n).orderBy("position").collect()
        assert [r["id"] for r in got] == want[:n]
    # the first round did not build everything
    assert built[0].count() < 100


def test_accept_until_with_nothing_acceptable(spark):
    assert sampling.accept_until(spark.range(50), ["id"], lambda rows: rows.limit(0), 3).count() == 0


def test_draw_with_retry_fills_every_shard(spark):
    def build(attempts):
        return attempts.filter(F.col("attempt") % 5 == 0)

    got = sampling.draw_with_retry(spark, 37, build, shards=3, quota=10).orderBy("shard", "slot").collect()
    assert [(r["shard"], r["slot"], r["attempt"]) for r in got] == [(s, i, 5 * i) for s in range(3) for i in range(10)]
    assert all(0 <= r["idx"] < 37 for r in got)
    want = [int(hashlib.md5(f"draw:{r['shard']}:{r['attempt']}".encode()).hexdigest()[:15], 16) % 37 for r in got]
    assert [r["idx"] for r in got] == want


def test_draws_ask_for_an_attempt_once_and_of_open_shards_only(spark):
    asked = []

    def build(attempts):
        asked.extend((r["shard"], r["attempt"]) for r in attempts.collect())
        # shard 0 accepts all, shard 1 every third, shard 2 starts late
        return attempts.filter((F.col("shard") == 0) | (F.col("shard") == 1) & (F.col("attempt") % 3 == 0) | (F.col("attempt") > 40))

    got = sampling.draw_with_retry(spark, 9, build, shards=3, quota=5).collect()
    want = {0: [0, 1, 2, 3, 4], 1: [0, 3, 6, 9, 12], 2: [41, 42, 43, 44, 45]}
    assert {s: sorted(r["attempt"] for r in got if r["shard"] == s) for s in range(3)} == want
    assert len(asked) == len(set(asked)) and sorted(a for s, a in asked if s == 0) == [0, 1, 2, 3, 4]
    for s in range(3):
        own = sorted(a for x, a in asked if x == s)
        assert own == list(range(len(own)))


def test_draw_with_retry_gives_up(spark):
    with pytest.raises(RuntimeError, match="not filled"):
        sampling.draw_with_retry(spark, 3, lambda a: a.filter(F.col("attempt") < 0), 2, 4, max_factor=4)


def test_draw_k_rows(spark):
    ex = spark.range(300).withColumnRenamed("id", "example")
    got = sampling.draw_k_rows(ex, "example", 50, 6).collect()
    by = {}
    for r in got:
        by.setdefault(r["example"], []).append((r["slot"], r["idx"]))
    assert len(by) == 300
    for rows in by.values():
        idx = [i for _, i in sorted(rows)]
        assert [s for s, _ in sorted(rows)] == list(range(len(rows))) and len(set(idx)) == len(idx) <= 6
    assert {len(r) for r in by.values()} == {1, 2, 3, 4, 5, 6}
    # a table just as large as the largest draw
    tiny = sampling.draw_k_rows(ex, "example", 6, 6).groupBy("example").agg(F.countDistinct("idx").alias("n"), F.count("idx").alias("m"))
    assert tiny.filter("n <> m").count() == 0 and tiny.count() == 300
    with pytest.raises(ValueError):
        sampling.draw_k_rows(ex, "example", 5, 6)


def test_row_numbers_beyond_32_bits(spark):
    rows = 2**40
    got = sampling.attempts(spark, rows, 4, 0, 500).agg(F.max("idx").alias("hi"), F.avg("idx").alias("mean")).first()
    assert got["hi"] > 2**39 and abs(got["mean"] / rows - 0.5) < 0.05
    ex = spark.range(300).withColumnRenamed("id", "example")
    assert sampling.draw_k_rows(ex, "example", rows, 6).agg(F.max("idx")).first()[0] > 2**39


def test_every_choice_of_k_rows_is_as_likely(spark):
    """All ordered choices of distinct rows out of 4, over 6,000 examples."""
    ex = spark.range(6000).withColumnRenamed("id", "example")
    by = {}
    for r in sampling.draw_k_rows(ex, "example", 4, 3).collect():
        by.setdefault(r["example"], []).append((r["slot"], r["idx"]))
    chosen = [tuple(i for _, i in sorted(v)) for v in by.values()]
    for k, kinds in ((1, 4), (2, 12), (3, 24)):
        own = [c for c in chosen if len(c) == k]
        counts = [own.count(c) for c in set(own)]
        assert abs(len(own) - 2000) < 200 and len(counts) == kinds
        assert all(abs(n - len(own) / kinds) < 5 * (len(own) / kinds) ** 0.5 for n in counts)


def test_rate(spark):
    assert sampling.sample_rate(spark.range(1000), F.col("id"), 0.0).count() == 0
    assert sampling.sample_rate(spark.range(1000), F.col("id"), 1.0).count() == 1000
    assert 60 < sampling.sample_rate(spark.range(1000), F.col("id"), 0.1).count() < 140


def test_merge_keeps_copies_and_fills_columns(spark):
    a = spark.createDataFrame([("x", ["i"]), ("y", [])], "id string, images array<string>")
    b = spark.createDataFrame([("x", ["d"])], "id string, documents array<string>")
    got = merge_datasets([a, b, a]).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(5))
    assert sorted((r["dataset_no"], r["id"]) for r in got) == [(0, "x"), (0, "y"), (1, "x"), (2, "x"), (2, "y")]
    assert [r["images"] for r in got if r["dataset_no"] == 1] == [None]


def test_merge_of_equal_ids_is_stable(spark):
    """One id with many copies: the same positions for any partitioning, no window group of its size."""
    rows = [("same", [str(i % 3)]) for i in range(600)] + [(f"id{i}", ["x"]) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, images array<string>")
    seen = None
    for n in (1, 4, 16):
        got = sorted((r["position"], r["id"], tuple(r["images"])) for r in merge_datasets([df.repartition(n), df.limit(10)]).collect())
        assert [p for p, _, _ in got] == list(range(810))
        head = [x for x in got]
        assert seen is None or [(p, i) for p, i, _ in head] == seen
        seen = [(p, i) for p, i, _ in head]
