"""From raw documents to packed sequences: the stages of a training-data pipeline, each one operator.

``run`` writes the rows of every stage to the shared folder and reads them again before the next one, so a lost executor
costs no more than its part of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.common import rows_of
from chatloom.llm.exact_dedup import exact_duplicates
from chatloom.llm.mixing import training_rows
from chatloom.llm.packing import pack
from chatloom.llm.quality import good_documents
from chatloom.llm.queries import VOCABULARY, digests
from chatloom.llm.registry import query, table
from chatloom.llm.simhash import drop_near_duplicates
from chatloom.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; thresholds from the labels of the documents that came in."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    found = exact_duplicates(docs).filter("kept")
    wanted = found.select(F.col("doc_id").alias("_key"), F.col("text_print").alias("_print"))
    return rows_of(docs, wanted, "doc_id", "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose fingerprints are linked by differences of at most two bits."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as their source's target asks for, in the order of training."""
    return training_rows(docs, cut=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences. A document that the mix repeats has as many runs of pieces."""
    packed = pack(docs, public_tokenizers.path(VOCABULARY))
    return digests(packed).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("packing", packing)]

#: Fingerprints, training positions and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs, name)
    return docs
