"""Chat rows to token ids and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom import fixed_values as fv
from chatloom.functions import chat
from chatloom.operators.joins import MAX_BROADCAST_BYTES, attach_by_frequency
from chatloom.operators.once import compute_once
from chatloom.operators.ranking import hash_positions
from chatloom.registry import ModalitySpec
from chatloom.session import stage

# Ids of the special tokens; words follow.
UNK_ID, BOS_ID, EOS_ID, FIRST_WORD_ID = 0, 1, 2, 3
SPECIAL_IDS = {fv.UNK: UNK_ID, fv.BOS: BOS_ID, fv.EOS: EOS_ID}


def special_tokens(given: dict[str, int | None]) -> dict[str, int]:
    """Fill missing pad, mask, cls and sep tokens with the unknown token's id."""
    out = dict(given)
    for name in ("pad", "mask", "cls", "sep"):
        if out.get(name) is None:
            out[name] = out["unk"]
    return out


def with_pieces(rows: DataFrame, specs: Sequence[ModalitySpec], messages: str = "messages") -> DataFrame:
    """Add the rendered ``chat``, its ``pieces`` and the ``error`` that keeps the row from being encoded (or NULL)."""
    msgs = F.col(messages)
    rendered = compute_once(rows, chat=chat.render_chat(msgs))
    parted = compute_once(rendered, _parts=chat.split_instructions(F.col("chat")))
    cut = compute_once(parted, pieces=chat.part_pieces(F.col("_parts"), specs)).drop("_parts")
    return cut.withColumn("error", F.coalesce(chat.role_error(msgs), chat.placeholder_error(F.col("pieces"))))


def token_rows(pieces_rows: DataFrame, key: str, specs: Sequence[ModalitySpec]) -> DataFrame:
    """Long form ``(key, pos, token, code, trained)``, one row per position of the encoded sequence.

    The explode keeps the input's partitioning, so grouping by the key again needs no shuffle if the chat rows were
    already distributed by it.
    """
    return pieces_rows.select(key, F.posexplode(chat.piece_tokens(F.col("pieces"), specs)).alias("pos", "t")).select(
        key, F.col("pos").cast("bigint").alias("pos"), "t.token", "t.code", "t.trained"
    )


def build_vocab(tokens: DataFrame, column: str = "token", min_freq: int = 1) -> DataFrame:
    """Vocabulary ``(token, token_id, freq)`` of a column of tokens; NULL tokens (placeholders) are skipped.

    Counting combines on the map side, so frequent words cost nothing extra. Ids are positions in hash order, which
    distributes, whereas alphabetical ranks would need a global sort. Words rarer than ``min_freq`` are left out and
    encode as unknown. The special tokens always have the same ids.
    """
    spark = tokens.sparkSession
    counts = tokens.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("token")).agg(
        F.count(F.lit(1)).alias("freq")
    )
    counts = stage(counts, "token_counts")
    words = counts.filter(~F.col("token").isin(*SPECIAL_IDS) & (F.col("freq") >= min_freq))
    ranked = hash_positions(words, ["token"], "vocab", "token_id").select(
        "token", (F.col("token_id") + FIRST_WORD_ID).cast("bigint").alias("token_id"), "freq"
    )
    specials = spark.createDataFrame(list(SPECIAL_IDS.items()), "token string, token_id bigint")
    present = specials.join(F.broadcast(counts.filter(F.col("token").isin(*SPECIAL_IDS))), "token", "left")
    return stage(ranked.unionByName(present.select("token", "token_id", F.coalesce("freq", F.lit(0)).alias("freq"))), "vocab")


def attach_ids(tokens: DataFrame, vocab: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Give every position its id: the placeholder's code, the word's id, or the unknown id."""
    found = attach_by_frequency(tokens, vocab, "token", "freq", max_broadcast_bytes)
    return found.withColumn("token_id", F.coalesce("code", "token_id", F.lit(UNK_ID).cast("bigint")))


def collect_sequences(token_ids: DataFrame, key: str) -> DataFrame:
    """``(key, input_ids, labels)``: ids in order; labels equal the ids where trained and -100 elsewhere."""
    label = F.when(F.col("trained"), F.col("token_id")).otherwise(F.lit(fv.IGNORE_INDEX).cast("bigint"))
    packed = token_ids.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "token_id", label.alias("label")))).alias("_s")
    )
    return packed.select(
        key,
        F.transform("_s", lambda s: s["token_id"]).alias("input_ids"),
        F.transform("_s", lambda s: s["label"]).alias("labels"),
    )


def encode_chat(
    rows: DataFrame,
    key: str,
    specs: Sequence[ModalitySpec],
    vocab: DataFrame | None = None,
    min_freq: int = 1,
) -> DataFrame:
    """Encode chat rows. Rows with an error are left out; see ``fallback_next``.

    A chat row is one record with all its messages. For chats too long for that, ``operators.turns`` encodes turn by
    turn and gives the same sequence in pieces.

    Without a vocabulary one is built from the rows themselves.
    """
    good = with_pieces(rows, specs).filter(F.col("error").isNull())
    tokens = token_rows(good, key, specs)
    if vocab is None:
        vocab = build_vocab(tokens, min_freq=min_freq)
    return collect_sequences(attach_ids(tokens, vocab), key)


def supervised_tokens(encoded: DataFrame, key: str, labels: str = "labels") -> DataFrame:
    """Trained and masked positions per encoded row."""
    trained = F.size(F.filter(labels, lambda x: x != fv.IGNORE_INDEX)).cast("bigint")
    return encoded.select(key, trained.alias("trained_tokens"), (F.size(labels).cast("bigint") - trained).alias("masked_tokens"))
