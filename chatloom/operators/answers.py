"""Answers that are paid for once.

A model's answers are appended to a log as the tasks that asked for them finish: one JSON line for each attempt, with the
draw's name, shard, attempt and the row drawn. A build that is started again with the same log, after whatever happened to
the first, finds them there and asks only for what is missing. Answers are logged as they came, before anything is parsed:
a change of the rules that accept them costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.sources.files import append_jsonl, path_exists, read_jsonl

LOG = "draw string, shard bigint, attempt bigint, idx bigint, response string"
KEYS = ["shard", "attempt", "idx"]


def logged_answers(spark: SparkSession, log: str, draw: str) -> DataFrame:
    """``shard, attempt, idx, response`` of a draw. An attempt that a repeated task asked twice has one answer here."""
    empty = spark.createDataFrame([], LOG)
    found = read_jsonl(spark, log, empty.schema) if path_exists(spark, log) else empty
    return found.filter(F.col("draw") == draw).groupBy(*KEYS).agg(F.min("response").alias("response"))


def ask_once(attempts: DataFrame, ask: Callable[[DataFrame], DataFrame], log: str, draw: str, idx: Column) -> DataFrame:
    """``shard, attempt, idx, response`` of the ``attempts``, of which only those that the log lacks are asked for.

    ``ask`` takes attempts (shard, attempt, idx) and gives ``shard, attempt, response``. What its tasks return goes to the log
    with no shuffle in between, so an abort loses no more than the tasks under way. An attempt that gets no answer is logged
    with a NULL. ``idx`` is the row that (shard, attempt) stands for; an answer counts for that row only, so that a source with
    another number of rows is asked again.
    """
    spark = attempts.sparkSession
    todo = attempts.join(logged_answers(spark, log, draw), KEYS, "left_anti")
    if not todo.isEmpty():
        given = ask(todo).select(F.lit(draw).alias("draw"), "shard", "attempt", idx.alias("idx"), "response")
        append_jsonl(given, log)
        silent = attempts.join(logged_answers(spark, log, draw), KEYS, "left_anti")
        if not silent.isEmpty():
            append_jsonl(silent.select(F.lit(draw).alias("draw"), *KEYS, F.lit(None).cast("string").alias("response")), log)
    return attempts.join(logged_answers(spark, log, draw), KEYS)
