import pytest
from fixtures import edge_docs, edge_rows, no_docs

import corpus_pipeline
import chatloom.llm.queries  # noqa: F401 - registers
from chatloom.llm.registry import ORACLES, QUERIES
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_as_by_sql(spark, name):
    verdict, _, _ = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name])
    assert verdict == "ok", verdict


def test_all_operators_are_registered():
    numbers = {int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in QUERIES


def test_stages_on_their_own_inputs(spark):
    """Whatever comes in, a stage gives rows of the same columns; none invents a document."""
    for rows in (edge_rows(), []):
        docs = edge_docs(spark, rows, clashes=False) if rows else no_docs(spark)
        texts = {r[1] for r in rows}
        for name, step in corpus_pipeline.STAGES:
            made = step(spark, docs, SF)
            if name == "packing":
                assert {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(made.columns)
                made.count()
                continue
            assert made.columns == docs.columns and made.dtypes == docs.dtypes
            assert {r["text"] for r in made.select("text").collect()} <= texts


def test_whole_run(spark):
    """Every stage's decisions take effect: the packed documents are those that all stages left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
    want = docs.groupBy("doc_id").count().collect()
    got = corpus_pipeline.run(spark, SF).filter("start = 0").groupBy("doc_id").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert 0 < len(got) < spark.read.parquet(f"{SF}/documents.parquet").count()
