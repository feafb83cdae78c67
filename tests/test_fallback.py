import random

import pytest

from chatloom.operators.fallback import fallback_map, fallback_next


def brute(flags):
    n = len(flags)
    out = []
    for i in range(n):
        j = i
        while not flags[j]:
            j = (j + 1) % n
        out.append(j)
    return out


def frame(spark, flags, n=4):
    return spark.createDataFrame([(i, f, f"row{i}") for i, f in enumerate(flags)], "idx long, ok boolean, payload string").repartition(n)


def mapped(spark, flags, block):
    got = fallback_map(frame(spark, flags).select("idx", "ok"), block=block).collect()
    return [s for _, s in sorted((r["idx"], r["source"]) for r in got)]


def test_hand_case(spark):
    assert mapped(spark, [True, False, False, True, False], 1 << 20) == [0, 3, 3, 3, 0]


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_equals_brute_force(spark, block):
    rng = random.Random(block)
    flags = [rng.random() < 0.2 for _ in range(120)]
    flags[5] = True
    assert mapped(spark, flags, block) == brute(flags)


def test_one_good_row_serves_all(spark):
    flags = [False] * 40
    flags[17] = True
    rows = fallback_next(frame(spark, flags), block=8).collect()
    assert len(rows) == 40 and {r["payload"] for r in rows} == {"row17"} and sorted(r["idx"] for r in rows) == list(range(40))


def test_payload_and_partitions(spark):
    flags = [i % 5 in (0, 3) for i in range(57)]
    want = [(i, s, f"row{s}") for i, s in enumerate(brute(flags))]
    for n in (1, 4, 16):
        got = fallback_next(frame(spark, flags, n), block=10).select("idx", "source", "payload").collect()
        assert sorted(map(tuple, got)) == want


def test_no_good_row_is_an_error(spark):
    with pytest.raises(Exception, match="no row can be encoded"):
        fallback_next(frame(spark, [False, False])).collect()


def test_an_index_with_gaps(spark):
    rows = spark.createDataFrame([(i * 10**7 + 5, i % 4 == 3, f"p{i}") for i in range(40)], "idx long, ok boolean, payload string").repartition(3)
    got = {r["idx"]: (r["source"], r["payload"]) for r in fallback_next(rows, block=8).collect()}
    assert len(got) == 40
    for i in range(40):
        j = i + (3 - i % 4)
        assert got[i * 10**7 + 5] == (j * 10**7 + 5, f"p{j}")
