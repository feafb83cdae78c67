import hashlib
from collections import defaultdict

import numpy as np
import pytest
from fixtures import edge_docs, edge_rows, no_docs

from chatloom.llm import golomb
from chatloom.llm.exact_dedup import exact_duplicates


@pytest.mark.parametrize("n, bits", [(1, 0), (2, 3), (1000, 0), (1000, 5), (5, 14)])
def test_golomb_code_is_lossless(n, bits):
    rng = np.random.default_rng(n)
    width = 64 - bits
    start = (1 << width) * ((1 << bits) - 1)
    values = np.sort(np.uint64(start) + rng.integers(0, 1 << min(width, 63), n, dtype=np.uint64))
    values[n // 2 :] = values[n // 2]  # repeats
    shift, high, low = golomb.encode(values, start, width)
    assert (golomb.decode(n, shift, high, low, start) == values).all()
    assert len(high) + len(low) <= n * 8 + 16


def test_code_is_smaller_than_the_numbers():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64))
    _, high, low = golomb.encode(values, 0, 64)
    assert len(high) + len(low) < 0.85 * 8 * len(values)


@pytest.mark.parametrize("rows_for_owner", [1 << 14, 8])
def test_groups_as_by_brute_force(spark, monkeypatch, rows_for_owner):
    import chatloom.llm.exact_dedup as module

    monkeypatch.setattr(module, "OWNER_ROWS", rows_for_owner)
    rows = edge_rows()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = exact_duplicates(edge_docs(spark)).collect()
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for r in got:
        ids = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == (max(known) if known else None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_normalised_texts(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "c")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["kept"] for r in exact_duplicates(docs, normalise=lambda c: F.regexp_replace(F.lower(c), " +", " ")).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_empty_table(spark):
    assert exact_duplicates(no_docs(spark)).count() == 0


def test_an_owner_gets_one_fingerprint_for_each_partition():
    import pyarrow as pa
    from chatloom.llm import exact_dedup as module

    hot, twice, once = 7, 1 << 40, -5
    first = pa.table({"_part": pa.array([0] * 1003, pa.int32()), "_print": [hot] * 1000 + [twice, twice, once]})
    second = pa.table({"_part": pa.array([1] * 2, pa.int32()), "_print": [hot, 9]})
    sent = [module._sender(0)(t) for t in (first, second)]
    assert [t["n"].to_pylist() for t in sent] == [[3], [2]]
    answers = module._answerer(0)(pa.concat_tables(sent))
    marked = [module._marker(0)(t, answers.filter(pa.array([p == i for p in answers["_part"].to_pylist()]))) for i, t in enumerate((first, second))]
    assert [t["_print"].to_pylist() for t in marked] == [[hot] * 1000 + [twice, twice], [hot]]
