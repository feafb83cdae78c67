import math
from collections import defaultdict

import pytest
from fixtures import edge_docs, edge_rows, no_docs

from chatloom.llm.mixing import first_position, mix_sources, training_rows


def size_of(text):
    return len((text or "").encode().split())


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """The contract by its words: reshare the excess by weight until no source is above its stop."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = goal - sum(fixed.values())
        at = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if at[s] > most * sizes[s]]
        if not above:
            return fixed | at
        fixed |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("cut", [True, False])
def test_edges(spark, cut):
    rows = edge_rows()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size_of(r[1])
    want = targets(sizes)
    docs = edge_docs(spark)
    mixed = mix_sources(docs, cut=cut).select("doc_id", "source", "size", "source_size", "target", "taken", "takes", first_position().alias("p"))
    got = mixed.collect()
    assert len(got) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["p"] is None) == (r["taken"] == 0)
        assert all(0 <= t["position"] <= 1 and 0 < t["words"] <= r["size"] for t in r["takes"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= (0.5 if cut else largest[s] / 2 + 0.5)

    def plain(df):
        return sorted((str(r["doc_id"]), r["size"], r["taken"], str(r["takes"])) for r in df.collect())

    assert plain(mixed) == plain(mix_sources(docs.repartition(7), cut=cut))


def test_rows_of_the_mix_have_the_words_taken(spark):
    rows = edge_rows()
    docs = edge_docs(spark)
    made = training_rows(docs)
    assert made.columns == docs.columns
    by = defaultdict(int)
    for r in made.collect():
        by[r["doc_id"]] += size_of(r["text"])
        assert any((r["doc_id"], r["source"]) == (x[0], x[3]) and (x[1] or "").startswith(r["text"]) for x in rows)
    want = defaultdict(int)
    for r in mix_sources(docs).collect():
        want[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in want.items() if v} == dict(by)


def test_schedules_shift_sources_in_time(spark):
    docs = spark.createDataFrame([(i, "a b c d", "ab"[i % 2]) for i in range(2000)], "doc_id bigint, text string, source string")
    got = mix_sources(docs, weights=(1, 1), schedules=((0.0, 2.0), (2.0, 0.0)), share=1.0).select("source", first_position().alias("p")).collect()
    early = {s: sum(r["p"] < 0.5 for r in got if r["source"] == s) / 1000 for s in "ab"}
    assert abs(early["a"] - 0.25) < 0.01 and abs(early["b"] - 0.75) < 0.01  # the integrals of t and of 1 - t
    order = [r["doc_id"] for r in training_rows(docs, weights=(1, 1), schedules=((0.0, 2.0), (2.0, 0.0)), share=1.0).collect()]
    assert sum(d % 2 for d in order[:500]) > 400


def test_empty_table(spark):
    assert mix_sources(no_docs(spark)).count() == 0
    assert training_rows(no_docs(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id bigint, text string, source string")
    assert [r["taken"] for r in mix_sources(nothing).collect()] == [0, 0]
