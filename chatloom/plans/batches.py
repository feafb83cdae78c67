"""From chat rows to training batches and to requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom import fixed_values as fv
from chatloom.operators import collating, encoding, fallback
from chatloom.operators.ranking import is_dense
from chatloom.registry import ModalitySpec
from chatloom.session import stage


def training_batches(
    chats: DataFrame,
    idx: str,
    specs: Sequence[ModalitySpec],
    batch_size: int,
    max_length: int,
    special: dict[str, int | None],
    vocab: DataFrame | None = None,
    min_freq: int = 1,
) -> DataFrame:
    """Encode, replace what cannot be encoded by the next good row, batch, pad, cut.

    Batches count the rows in the order of ``idx``. The result has one row per input row: ``idx, source, batch_id, input_ids, labels,
    attention_mask`` and the item lists of the row it was taken from.
    """
    items = [s.data_key for s in specs if s.data_key in chats.columns]
    flagged = encoding.with_pieces(chats, specs).select(idx, "messages", *items, F.col("error").isNull().alias("ok"))
    rows = stage(flagged, "flagged")
    encoded = encoding.encode_chat(rows.filter("ok"), idx, specs, vocab, min_freq)
    carried = fallback.fallback_next(rows.drop("messages"), idx, "ok")
    sequences = carried.join(encoded.withColumnRenamed(idx, "source"), "source")
    pad = encoding.special_tokens(special)["pad"]
    return collating.collate(sequences, idx, batch_size, pad, max_length, dense=is_dense(rows, idx))


def requests(chats: DataFrame, key: str, specs: Sequence[ModalitySpec], vocab: DataFrame) -> DataFrame:
    """Encoded prompts of the chats that wait for an answer (last message from the user), with their length."""
    waiting = chats.filter(F.element_at("messages", -1)["role"] == fv.ROLE_USER)
    encoded = encoding.encode_chat(waiting, key, specs, vocab)
    return encoded.select(key, "input_ids", F.size("input_ids").alias("prompt_length"))
