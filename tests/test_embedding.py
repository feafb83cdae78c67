import math
import random

import numpy as np
import pytest

from chatloom.operators import embedding
from chatloom.operators.blocks import store_vectors
from chatloom.operators.embedding import Projector
from chatloom.registry import ModalitySpec

A = ModalitySpec("a", "<image>", "images", 3)
B = ModalitySpec("b", "<document>", "documents", 2)


def spans(spark, sequences):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sequences)], "row long, input_ids array<long>")
    got = embedding.find_spans(df, "row", [A, B]).collect()
    return sorted((r["row"], r["name"], r["k"], r["start"], r["width"]) for r in got)


def test_hand_cases(spark):
    a = A.code
    assert spans(spark, [[a] * 6, [a] * 5, [a, a, 1, a], []]) == [(0, "a", 0, 0, 3), (0, "a", 1, 3, 3), (1, "a", 0, 0, 3)]


def test_spans_equal_a_greedy_scan(spark):
    rng = random.Random(3)
    sequences = [[rng.choice([A.code, A.code, A.code, B.code, B.code, 5]) for _ in range(rng.randint(0, 40))] for _ in range(60)]
    want = []
    for row, ids in enumerate(sequences):
        for spec in (A, B):
            pos, k = 0, 0
            while pos + spec.width <= len(ids):
                if all(x == spec.code for x in ids[pos : pos + spec.width]):
                    want.append((row, spec.name, k, pos, spec.width))
                    pos, k = pos + spec.width, k + 1
                else:
                    pos += 1
    assert spans(spark, sequences) == sorted(want)


def test_spans_need_no_shuffle(spark):
    df = spark.createDataFrame([(0, [A.code] * 6)], "row long, input_ids array<long>")
    assert "Exchange" not in embedding.find_spans(df, "row", [A, B])._jdf.queryExecution().executedPlan().toString()


def test_scatter_and_surplus(spark):
    df = spark.createDataFrame([(0, [1, *[A.code] * 6, 2])], "row long, input_ids array<long>")
    found = embedding.find_spans(df, "row", [A, B])
    slots = spark.createDataFrame(
        [(0, "a", 0, s, f"v{s}") for s in range(3)] + [(0, "a", 2, s, "x") for s in range(3)], "row long, name string, k long, slot long, vec string"
    )
    got = sorted((r["pos"], r["vec"], r["status"]) for r in embedding.scatter_items(found, slots, "row").collect())
    assert got == [(1, "v0", "filled"), (2, "v1", "filled"), (3, "v2", "filled")] + [(p, None, "missing item") for p in (4, 5, 6)]
    assert [tuple(r) for r in embedding.surplus_items(found, slots, "row").collect()] == [(0, "a", 2)]


def test_embed_tokens_leaves_placeholders_empty(spark):
    ids = spark.createDataFrame([(0, 0, 4), (0, 1, -9), (0, 2, 4)], "row long, pos long, token_id long")
    vectors = spark.createDataFrame([(4, 2, [1.0])], "token_id long, freq long, vec array<double>")
    got = embedding.embed_tokens(ids, vectors).orderBy("pos").collect()
    assert [(r["token_id"], r["vec"]) for r in got] == [(4, [1.0]), (-9, None), (4, [1.0])]


def test_masked_mean(spark):
    df = spark.createDataFrame(
        [("g", [1.0, 2.0], 1), ("g", [3.0, 6.0], 1), ("g", [100.0, 100.0], 0), ("h", [5.0, 5.0], 0)], "g string, v array<double>, m int"
    )
    pooled = embedding.masked_mean_pool(df, "g", "v", "m")
    got = {r["g"]: r["v"] for r in pooled.collect()}
    assert got["g"] == [2.0, 4.0]
    assert len(got["h"]) == 2 and all(map(math.isnan, got["h"]))
    plan = embedding.masked_mean_pool(df, "g", "v", "m")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1


def test_erf():
    x = np.concatenate([np.linspace(-7, 7, 4001), [0.0, 1e-12, -1e-300]])
    assert np.allclose(embedding.erf(x), [math.erf(v) for v in x], rtol=4e-15, atol=0)


def test_input_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, v array<double>")
    stored = store_vectors(vectors, ["vec_id"], "v", 2, "double")
    at = {r["vec_id"]: (r["block"], r["place"]) for r in stored.index.collect()}
    schema = "row long, pos long, block long, place int"
    embedded = spark.createDataFrame([(0, 0, *at[1]), (0, 1, None, None), (0, 2, None, None)], schema)
    filled = spark.createDataFrame([(0, 1, *at[2]), (0, 2, None, None)], schema)
    got = embedding.input_vectors(embedded, filled, "row", stored, "v").orderBy("pos").collect()
    assert [(r["kind"], r["v"]) for r in got] == [("text", [1.0, 2.0]), ("item", [3.0, 4.0]), ("zero", [0.0, 0.0])]


def test_loss_is_one_mean_over_shifted_positions(spark):
    rows = [(0, 0, [False, True, False, True]), (1, 0, [True, False]), (2, 1, [True])]
    long = [(r, b, p, t) for r, b, ts in rows for p, t in enumerate(ts)]
    df = spark.createDataFrame(long, "row long, batch long, pos long, trained boolean")
    nll = spark.createDataFrame([(r, p, float(10 * r + p)) for r, _, p, _ in long], "row long, pos long, nll double")
    for n in (1, 4, 16):
        got = embedding.supervised_loss(df.repartition(n), "row", nll, ["batch"]).collect()
        # positions 0 and 2 of row 0 predict a trained token; nothing predicts the first of a row
        assert [(r["batch"], r["loss"], r["positions"]) for r in got] == [(0, 1.0, 2)]


def random_projector(slots, size, hidden, layers=2):
    rng = np.random.default_rng(1)
    dims = [size] + [hidden] * layers
    return Projector(
        tuple(tuple((rng.normal(size=(a, b)), rng.normal(size=b)) for a, b in zip(dims, dims[1:])) for _ in range(slots))
    )


def test_projection_equals_numpy(spark):
    p = random_projector(3, 6, 4)
    x = np.random.default_rng(2).normal(size=(20, 6))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>").repartition(3)
    got = {(r["id"], r["slot"]): r["projected"] for r in embedding.project_vectors(df, "id", "v", p).collect()}
    assert len(got) == 60
    for i, row in enumerate(x):
        for s, ((w1, b1), (w2, b2)) in enumerate(p.layers):
            h = row @ w1 + b1
            h = np.array([0.5 * t * (1 + math.erf(t / math.sqrt(2))) for t in h])
            assert np.allclose(got[(i, s)], h @ w2 + b2)


def test_large_weights_are_refused(spark, monkeypatch):
    monkeypatch.setattr(embedding, "MAX_WEIGHT_BYTES", 10)
    df = spark.createDataFrame([(0, [1.0])], "id long, v array<double>")
    with pytest.raises(ValueError, match="too large"):
        embedding.project_vectors(df, "id", "v", random_projector(1, 1, 2))
