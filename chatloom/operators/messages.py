"""From turns to chat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import normalize_role


def assemble_messages(turns: DataFrame, key: str, order: str, role: Column, content: Column, out: str = "messages") -> DataFrame:
    """One row per chat with its ordered ``array<struct<role, content>>``.

    A chat row is one record in the data model, so its turns have to meet. Analyses that need no record
    (``token_accounting``) work on turns instead.
    """
    packed = turns.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), role.alias("role"), content.alias("content")))).alias("_t")
    )
    return packed.select(
        key, F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias(out)
    )


def convert_dialog(dialog: Column) -> Column:
    """``array<struct<from, value>>`` to messages. An unknown speaker leaves a NULL role."""
    return F.transform(dialog, lambda t: F.struct(normalize_role(t["from"]).alias("role"), t["value"].alias("content")))


def unknown_role(messages: Column) -> Column:
    return F.exists(messages, lambda m: m["role"].isNull())


def split_rejects(df: DataFrame, reason: Column, on_error: str = "reject") -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejected rows (with ``reject_reason``).

    ``on_error="fail"`` raises on the first bad row instead of setting it aside.
    """
    if on_error not in ("reject", "fail"):
        raise ValueError(on_error)
    if on_error == "fail":
        checked = df.withColumn("_bad", F.when(reason.isNotNull(), F.raise_error(reason)).otherwise(F.lit(None)))
        return checked.filter(F.col("_bad").isNull()).drop("_bad"), df.limit(0).withColumn("reject_reason", F.lit(None).cast("string"))
    marked = df.withColumn("reject_reason", reason)
    return marked.filter(F.col("reject_reason").isNull()).drop("reject_reason"), marked.filter(F.col("reject_reason").isNotNull())


def qa_pairs(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """Question and answer of every user turn that is followed by an assistant turn.

    An equi-join on (chat, turn + 1): the join key is unique, so one huge chat spreads over all tasks.
    """
    asked = turns.filter(F.col(role) == "user").select(key, order, F.col(text).alias("question"))
    answered = turns.filter(F.col(role) == "assistant").select(
        key, (F.col(order) - 1).alias(order), F.col(text).alias("answer")
    )
    return asked.join(answered, [key, order])
