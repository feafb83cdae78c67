import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.operators import embedding, hooks
from chatloom.registry import ModalitySpec


def toy() -> ModalitySpec:
    def shout(lists):
        if any("bad" in items for items in lists):
            raise ValueError("bad item")
        return ["+".join(items).upper() for items in lists]

    def lengths(values):
        return [[len(v), 1.0] for v in values]

    return ModalitySpec("toy", "<toy>", "toys", 2, preprocess=shout, encode=lengths)


TOY = toy()
PLAIN = ModalitySpec("plain", "<plain>", "toys", 2)


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(0, ["a", "b"]), (1, []), (2, None), (3, ["bad"]), (4, ["c"])], "id long, toys array<string>")


def test_preprocess_hook(items):
    got = {r["id"]: (r["value"], r["error"]) for r in hooks.preprocess_rows(items.coalesce(1), "id", TOY, T.StringType()).collect()}
    assert got == {0: ("A+B", None), 1: ("", None), 2: (None, "no toys"), 3: (None, "ValueError: bad item"), 4: ("C", None)}


def test_without_a_hook_the_list_is_the_value(items):
    got = {r["id"]: r["value"] for r in hooks.preprocess_rows(items, "id", PLAIN, T.ArrayType(T.StringType())).collect()}
    assert got == {0: ["a", "b"], 1: [], 2: None, 3: ["bad"], 4: ["c"]}


def test_encode_hook_feeds_scatter(spark, items):
    flat = items.select("id", F.posexplode_outer("toys").alias("k", "value")).filter("k is not null")
    vectors = hooks.encode_items(flat, "id", TOY)
    assert sorted((r["id"], r["k"], r["vector"]) for r in vectors.collect())[:2] == [(0, 0, [1.0, 1.0]), (0, 1, [1.0, 1.0])]
    spans = embedding.find_spans(
        spark.createDataFrame([(0, [TOY.code] * 4)], "id long, input_ids array<long>"), "id", [TOY]
    )
    slots = vectors.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("slot"))
    filled = embedding.scatter_items(spans, slots, "id").collect()
    assert sorted(r["pos"] for r in filled) == [0, 1, 2, 3] and all(r["status"] == "filled" for r in filled)
    with pytest.raises(ValueError):
        hooks.encode_items(flat, "id", PLAIN)


def test_setup_runs_once_in_a_worker(spark, tmp_path):
    """However many tasks and batches a worker gets."""
    folder = str(tmp_path)

    def load():
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write("x")
        return {"factor": 3.0}

    def scaled(state, values):
        return np.array([[len(v) * state["factor"]] for v in values])

    def joined(state, lists):
        return [str(state["factor"]) + "".join(v) for v in lists]

    spec = ModalitySpec("loaded", "<loaded>", "toys", 1, preprocess=joined, encode=scaled, setup=load)
    flat = spark.range(400).select(F.lit(0).alias("id"), F.col("id").alias("k"), F.lit("ab").alias("value")).repartition(40)
    assert {tuple(r["vector"]) for r in hooks.encode_items(flat, "id", spec).collect()} == {(6.0,)}
    lists = spark.createDataFrame([(i, ["a"]) for i in range(50)], "id long, toys array<string>").repartition(20)
    assert {r["value"] for r in hooks.preprocess_rows(lists, "id", spec, T.StringType()).collect()} == {"3.0a"}
    runs = [open(f"{folder}/{name}").read() for name in os.listdir(folder)]
    assert runs and set(runs) == {"x"}


def test_hooks_get_bounded_batches(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["x" * (5000 if i == 50 else 10) for i in range(100)])], names=["k", "v"])
    parts = list(hooks.slices(batch, 1, 200))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or p.column(1).nbytes <= 400 for p in parts)
    assert [p.num_rows for p in hooks.slices(batch, 1)] == [100]


def test_a_wrong_number_of_values_is_an_error(spark, items):
    few = ModalitySpec("few", "<few>", "toys", 1, preprocess=lambda lists: ["x"], encode=lambda values: [])
    got = {r["id"]: (r["value"], r["error"]) for r in hooks.preprocess_rows(items.coalesce(1), "id", few, T.StringType()).collect()}
    assert got[0] == ("x", None) and got[2] == (None, "no toys")  # one by one the number is right
    flat = items.select("id", F.posexplode("toys").alias("k", "value"))
    with pytest.raises(Exception, match="0 vectors for"):
        hooks.encode_items(flat, "id", few).collect()
