"""Encoded rows to training batches, and generated ids back to text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom import fixed_values as fv
from chatloom.operators.joins import attach_by_frequency
from chatloom.operators.ranking import is_dense, range_positions


def collate(
    encoded: DataFrame,
    idx: str,
    batch_size: int,
    pad_id: int,
    max_length: int,
    ids: str = "input_ids",
    labels: str = "labels",
    dense: bool | None = None,
) -> DataFrame:
    """Add ``batch_id``, pad every row to its batch's longest, cut to ``max_length``, add the attention mask.

    The mask is computed from values: if the pad id is also the unknown id, unknown tokens are masked too. A batch
    has ``batch_size`` rows, so the window groups stay small. Rows are counted in the order of ``idx``; one with gaps is
    numbered anew, unless ``dense`` tells that it has none.
    """
    number = F.col(idx)
    if not (is_dense(encoded, idx) if dense is None else dense):
        encoded, number = range_positions(encoded, idx, "_number"), F.col("_number")
    batched = encoded.withColumn("batch_id", F.floor(number / F.lit(batch_size)).cast("bigint")).drop("_number")
    longest = batched.withColumn("_longest", F.max(F.size(ids)).over(Window.partitionBy("batch_id")))
    missing = F.col("_longest") - F.size(ids)
    padded = longest.withColumn(
        "_ids", F.concat(F.col(ids), F.array_repeat(F.lit(pad_id).cast("bigint"), missing))
    ).withColumn("_labels", F.concat(F.col(labels), F.array_repeat(F.lit(fv.IGNORE_INDEX).cast("bigint"), missing)))
    cut = padded.withColumn(ids, F.slice("_ids", 1, max_length)).withColumn(labels, F.slice("_labels", 1, max_length))
    return cut.withColumn("attention_mask", F.transform(ids, lambda x: x != pad_id)).drop("_longest", "_ids", "_labels")


def decode_outputs(outputs: DataFrame, key: str, ids: str, prompt_length: str, vocab: DataFrame, special_ids: list[int]) -> DataFrame:
    """``(key, output)``: the generated part of each id sequence as text, special tokens skipped.

    Words are joined by one blank. A sequence with nothing but special tokens gives an empty text.
    """
    begin = F.col(f"`{prompt_length}`").cast("int")
    made = F.slice(F.col(f"`{ids}`"), begin + 1, F.greatest(F.size(F.col(f"`{ids}`")) - begin, F.lit(0)))
    answer = F.filter(made, lambda i: ~i.isin(*special_ids) & (i >= 0))
    flat = outputs.select(key, F.posexplode_outer(answer).alias("pos", "token_id"))
    words = attach_by_frequency(flat, vocab, "token_id", "freq")
    packed = words.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", "token")))).alias("_w")
    )
    return packed.select(key, F.array_join(F.transform("_w", lambda w: w["token"]), " ").alias("output"))
