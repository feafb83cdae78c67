from pyspark.sql import functions as F

from chatloom.operators import joins


def test_resolve_refs_with_one_hot_row(spark):
    refs = spark.range(3000).select(
        "id", F.lit("d").alias("dataset"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("long").alias("idx")
    )
    source = spark.range(40).select(F.col("id").alias("idx"), F.concat(F.lit("t"), "id").alias("text"))
    found = joins.resolve_refs(refs, {"d": source})
    lost = joins.dangling_refs(refs, {"d": source})
    assert found.filter(F.col("text") != F.concat(F.lit("t"), "idx")).count() == 0
    assert found.count() + lost.count() == 3000 and lost.filter("idx < 40").count() == 0


def test_stored_references_by_one_join(spark):
    args = "struct<path: string, name: string, split: string>"
    refs = spark.createDataFrame([(1, (("d", None, "train"), 0)), (2, (("d", "n", None), 5)), (3, (("x", None, None), 0)), (4, None)], f"id int, ref struct<dataset_args: {args}, idx: bigint>")
    sources = {"d/train": spark.createDataFrame([(0, None)], "idx long, text string"), "d/n": spark.createDataFrame([(5, "t")], "idx long, text string")}
    found = joins.attach_refs(refs, sources, reference="ref")
    assert found.columns == ["id", "ref", "text", "verdict"]
    assert sorted((r["id"], r["text"], r["verdict"]) for r in found.collect()) == [(1, None, "resolved"), (2, "t", "resolved"), (3, None, "dangling"), (4, None, "dangling")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert joins.resolve_refs(refs, sources, reference="ref").count() == 2 and joins.dangling_refs(refs, sources, reference="ref").count() == 2


def test_keep_existing(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "i int, path string")
    manifest = spark.createDataFrame([("a", 1), ("a", 2)], "path string, length long")
    assert sorted(r["i"] for r in joins.keep_existing(rows, manifest).collect()) == [1, 4]
    assert sorted(r["i"] for r in joins.missing_files(rows, manifest).collect()) == [2, 3]


def test_attach_by_frequency_head_and_tail(spark):
    words = ["the"] * 500 + [f"w{i % 40}" for i in range(400)] + [None] * 100 + ["odd"] * 3
    facts = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, word string")
    dim = facts.filter("word is not null and word <> 'odd'").groupBy("word").agg(F.count("i").alias("freq"))
    dim = dim.withColumn("code", F.length("word") * 100 + F.col("freq"))

    def rows(df):
        return sorted(map(tuple, df.select("i", "word", "code").collect()))

    whole = rows(joins.attach_by_frequency(facts, dim, "word"))
    for limit in (1, 300, 1500):
        met = joins.attach_by_frequency(facts, dim, "word", max_broadcast_bytes=limit)
        assert rows(met) == whole and met.columns == ["i", "word", "code"]
    assert len(whole) == len(words)


def test_facts_are_read_once(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id % 7 as string) as word").write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    dim = spark.createDataFrame([(str(k), 143, ["t" * 50]) for k in range(7)], "word string, freq long, texts array<string>")
    met = joins.attach_by_frequency(facts, dim, "word", max_broadcast_bytes=500)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "Union" not in plan
    assert met.filter("texts[0] is not null").count() == 1000


def test_one_huge_row_does_not_empty_the_head(spark):
    dim = spark.createDataFrame([(f"w{k}", 1000 - k, "c") for k in range(500)] + [("x" * 200_000, 1, "c")], "word string, freq long, c string")
    floor = joins._head_floor(dim, ["word", "c"], "freq", 100_000)
    assert 1 < floor <= 600  # all but the huge one fit
    assert joins._head_floor(dim, ["word", "c"], "freq", 1 << 20) == 0
    assert joins._head_floor(dim, ["word", "c"], "freq", 10) > 10**6


def test_a_frequent_unknown_key_stays_whole(spark):
    facts = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'unknown', cast(id % 5 as string)) as word")
    dim = spark.createDataFrame([(str(k), 600, k) for k in range(5)], "word string, freq long, code long")
    met = joins.attach_by_frequency(facts, dim, "word", max_broadcast_bytes=1)
    assert met.count() == 5000 and met.filter("code is null").count() == 1667


def test_references_as_stored(spark):
    args = "struct('p' as path, 'en' as name, 'train' as split)"
    refs = spark.range(6).selectExpr("id", f"named_struct('dataset_args', {args}, 'idx', id * 2) as item")
    rows = spark.range(7).selectExpr("id as idx", "concat('t', id) as text")
    found = joins.resolve_refs(refs, {"p/en/train": rows}, reference="item").collect()
    assert {r["id"]: r["text"] for r in found} == {0: "t0", 1: "t2", 2: "t4", 3: "t6"}
    assert sorted(r["id"] for r in joins.dangling_refs(refs, {"p/en/train": rows}, reference="item").collect()) == [4, 5]


def test_wide_rows_are_not_all_broadcast(spark):
    facts = spark.createDataFrame([(i, i % 3) for i in range(90)], "i int, k int")
    dim = spark.createDataFrame([(k, 30, [float(k)] * 1000) for k in range(3)], "k int, freq long, vec array<double>")

    def broadcast_all(limit):
        plan = joins.attach_by_frequency(facts, dim, "k", max_broadcast_bytes=limit)
        assert plan.filter("vec[0] = k").count() == 90
        return plan._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1

    assert broadcast_all(1 << 20) and not broadcast_all(10_000)


def test_gather_rows_keeps_the_drawn_order(spark):
    draws = spark.createDataFrame([("e", 0, 5), ("e", 1, 2), ("f", 0, 2), ("e", 2, 9)], "example string, slot long, idx long")
    data = spark.range(10).select(F.col("id").alias("idx"), F.concat(F.lit("c"), "id").alias("caption"), F.col("id").alias("n"))
    got = {r["example"]: (r["caption"], r["n"]) for r in joins.gather_rows(draws, data, "example", ["caption", "n"]).collect()}
    assert got == {"e": (["c5", "c2", "c9"], [5, 2, 9]), "f": (["c2"], [2])}


def test_hot_keys(spark):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', if(id % 40 = 1, 'warm', concat('k', id))) as word")
    found = joins.hot_keys(rows.unionByName(spark.createDataFrame([(None,)] * 9000, "word string")).repartition(7), "word")
    assert sorted(found) == ["hot", "warm"]
    assert joins.hot_keys(rows.limit(0), "word") == []


def test_a_third_of_the_rows_with_an_unknown_key_is_spread(spark):
    """And one that the dimension knows, but calls rare."""
    n = 60_000
    facts = spark.range(n).selectExpr("id", "case when id % 3 = 0 then 'unknown' when id % 7 = 1 then 'called rare' else concat('w', id % 5000) end as word")
    dim = spark.range(5000).selectExpr("concat('w', id) as word", "5L as freq", "id as code")
    dim = dim.unionByName(spark.createDataFrame([("called rare", 5, -1), ("common", 900, -2)], "word string, freq bigint, code bigint"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "8", "-1")):
            spark.conf.set(k, v)
        met = joins.attach_by_frequency(facts, dim, "word", max_broadcast_bytes=200).withColumn("p", F.spark_partition_id())
        sizes = sorted(r["count"] for r in met.groupBy("p").count().collect())
        assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
        want = met.groupBy("word").agg(F.count("id").alias("n"), F.count_distinct("code").alias("codes"), F.min("code").alias("code"))
        got = {r["word"]: (r["n"], r["codes"], r["code"]) for r in want.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got["unknown"] == (n // 3, 0, None) and got["called rare"][1:] == (1, -1) and got["w2"][1:] == (1, 2)
    assert sum(v[0] for v in got.values()) == n
