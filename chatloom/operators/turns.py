"""Encoding from turns, for chats of any length.

The operators here never put a chat together. Per-chat facts are sums that combine before the shuffle, tokens are made
turn by turn, and positions come from running sums over blocks of turns, so one chat may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom import fixed_values as fv
from chatloom.functions import chat
from chatloom.functions.text import count_literal
from chatloom.functions.turns import (
    begin_piece,
    has_marks,
    open_throughout,
    piece_sizes,
    settled,
    size_sum,
    stray,
    total_length,
    turn_parts,
    turn_pieces,
)
from chatloom.operators.embedding import find_spans
from chatloom.operators.encoding import UNK_ID, attach_ids
from chatloom.operators.joins import MAX_BROADCAST_BYTES
from chatloom.operators.once import compute_once
from chatloom.registry import ModalitySpec

BLOCK_TURNS = 4096
LABELS = ("instruction", "at_end")

ROLE_ERROR = "roles do not alternate from user"
STRAY_ERROR = "placeholder outside an instruction"


def _expected(order: Column) -> Column:
    return F.when(order % 2 == 0, fv.ROLE_USER).otherwise(fv.ROLE_ASSISTANT)


def _with_pieces(turns: DataFrame, role: str, content: str, specs: Sequence[ModalitySpec]) -> DataFrame:
    """Add the ``_pieces`` of every turn, each labelled for the middle and for an open end of its chat."""
    parts = compute_once(turns, _parts=turn_parts(F.col(role), F.col(content)))
    return compute_once(parts, _pieces=turn_pieces(F.col("_parts"), specs)).drop("_parts")


def _chat_sums(
    turns: DataFrame, key: str, order: str, role: str, content: str, sums: dict[str, tuple[Column, Column]]
) -> DataFrame:
    """Per chat: whether it alternates properly, and sums of per-turn numbers ``{name: (normal, at the end)}``.

    The numbers of the last turn, and of the question before it, are corrected afterwards: the greatest
    (turn, differences) pair of all turns and of the user turns tells by how much.
    """
    at, asked = F.col(order), F.col(role) == fv.ROLE_USER
    wide = ~asked & open_throughout(F.col(content))
    deltas = [(last - normal).alias(name) for name, (normal, last) in sums.items()]
    totals = turns.groupBy(key).agg(
        F.count(F.lit(1)).alias("_turns"),
        F.min(at).alias("_min"),
        F.max(at).alias("_max"),
        F.bool_and(F.coalesce(F.col(role) == _expected(at), F.lit(False))).alias("_fits"),
        F.max(F.struct(at, asked.alias("asked"), wide.alias("wide"), *deltas)).alias("_end"),
        F.max(F.when(asked, F.struct(at, *deltas))).alias("_ask"),
        *[F.sum(normal).alias(name) for name, (normal, _) in sums.items()],
    )
    proper = F.col("_fits") & (F.col("_min") == 0) & (F.col("_max") == F.col("_turns") - 1)

    def corrected(name: str) -> Column:
        own = F.when(F.col("_end.asked"), 0).otherwise(F.col("_end")[name])
        question = F.when(F.col("_end.wide"), F.coalesce(F.col("_ask")[name], F.lit(0))).otherwise(0)
        return (F.col(name) + own + question).alias(name)

    return totals.select(
        key, proper.alias("proper"), F.col("_max").alias("last_turn"), F.col("_end.wide").alias("wide"), *[corrected(n) for n in sums]
    )


def token_accounting(
    turns: DataFrame, key: str, order: str, role: str, content: str, specs: Sequence[ModalitySpec] = ()
) -> DataFrame:
    """Trained and masked positions per chat that can be encoded; the begin marker is trained.

    One aggregation over per-turn counts; without placeholders no id is ever looked up.
    """
    pieces = _with_pieces(turns, role, content, specs)
    # the only place where text is tokenized
    sized = compute_once(pieces, _sizes=piece_sizes(F.col("_pieces"), specs))
    sums = {
        "trained": tuple(size_sum(F.col("_sizes"), label, False) for label in LABELS),
        "masked": tuple(size_sum(F.col("_sizes"), label, True) for label in LABELS),
        "stray": tuple(stray(F.col("_pieces"), label).cast("bigint") for label in LABELS),
    }
    counted = compute_once(sized, **{f"_{n}{i}": pair[i] for n, pair in sums.items() for i in (0, 1)})
    sums = {n: (F.col(f"_{n}0"), F.col(f"_{n}1")) for n in sums}
    chats = _chat_sums(counted, key, order, role, content, sums)
    return chats.filter(F.col("proper") & (F.col("stray") == 0)).select(
        key, (F.col("trained") + 1).alias("trained_tokens"), F.col("masked").alias("masked_tokens")
    )


def _verdicts(turns: DataFrame, key: str, order: str, role: str, content: str, specs: Sequence[ModalitySpec]) -> DataFrame:
    """``(key, error, has_marks, last_turn, wide)`` per chat. Turns without any placeholder are not split for it."""
    may_stray = F.lit(False)
    for s in specs:
        may_stray = may_stray | F.col(content).contains(s.token)
    pieces = _with_pieces(
        turns.withColumn("_content", F.when(may_stray, F.col(content)).otherwise("")), role, "_content", specs
    )
    normal, at_end = (stray(F.col("_pieces"), label).cast("bigint") for label in LABELS)
    counted = compute_once(pieces, _stray0=normal, _stray1=at_end, _marks=has_marks(F.col(content)).cast("bigint"))
    chats = _chat_sums(
        counted, key, order, role, content, {"stray": (F.col("_stray0"), F.col("_stray1")), "marks": (F.col("_marks"), F.col("_marks"))}
    )
    error = F.when(~F.col("proper"), ROLE_ERROR).when(F.col("stray") > 0, STRAY_ERROR)
    return chats.select(key, error.alias("error"), (F.col("marks") > 0).alias("has_marks"), "last_turn", "wide")


def encode_errors(turns: DataFrame, key: str, order: str, role: str, content: str, specs: Sequence[ModalitySpec]) -> DataFrame:
    """Per chat why it cannot be encoded (or NULL), and whether its text holds instruction marks of its own."""
    return _verdicts(turns, key, order, role, content, specs).select(key, "error", "has_marks")


def placeholder_counts(turns: DataFrame, key: str, content: str, specs: Sequence[ModalitySpec]) -> DataFrame:
    """``(key, name, placeholders, width)`` per chat and modality."""
    sums = turns.groupBy(key).agg(*[F.sum(count_literal(F.col(content), s.token)).alias(s.name) for s in specs])
    per_spec = F.array(
        *[
            F.struct(F.lit(s.name).alias("name"), F.col(s.name).alias("placeholders"), F.lit(s.width).cast("bigint").alias("width"))
            for s in specs
        ]
    )
    return sums.select(key, F.inline(per_spec))


def validate_items(turns: DataFrame, items: DataFrame, key: str, content: str, specs: Sequence[ModalitySpec]) -> DataFrame:
    """``(key, name, placeholders, items, verdict)``: the placeholders of each modality and the items a chat carries.

    ``items`` has the key and the item lists, one row for each chat; a NULL list counts as empty. Texts are counted turn
    by turn and never put together.
    """
    counts = placeholder_counts(turns, key, content, specs).drop("width")
    listed = F.array(
        *[F.struct(F.lit(s.name).alias("name"), F.coalesce(F.size(F.col(s.data_key)), F.lit(0)).cast("bigint").alias("items")) for s in specs]
    )
    met = counts.join(items.select(key, F.inline(listed)), [key, "name"])
    verdict = (
        F.when(F.col("items") < F.col("placeholders"), "too few items")
        .when(F.col("items") > F.col("placeholders"), "surplus items")
        .otherwise("ok")
    )
    return met.withColumn("verdict", verdict)


def encodable_turns(
    turns: DataFrame, key: str, order: str, role: str, content: str, specs: Sequence[ModalitySpec]
) -> DataFrame:
    """``(key, order, pieces, length)`` of the turns of chats without error, spread evenly over the partitions.

    Turns meet the per-chat verdicts in a join whose chat side is unique; a chat that holds most turns is split by
    adaptive execution. Then (key, order) - unique, hence never skewed - distributes the turns, and all later
    per-turn grouping finds them in place.
    """
    good = _verdicts(turns, key, order, role, content, specs).filter(F.col("error").isNull()).select(key, "last_turn", "wide")
    kept = turns.select(key, order, role, content).join(good, key)
    kept = kept.repartition(key, order)
    at_end = F.when(F.col(role) == fv.ROLE_USER, F.col("wide") & (F.col(order) == F.col("last_turn") - 1)).otherwise(
        F.col(order) == F.col("last_turn")
    )
    found = _with_pieces(kept, role, content, specs)
    pieces = compute_once(
        found,
        pieces=F.concat(
            F.when(F.col(order) == 0, F.array(begin_piece())).otherwise(F.array().cast("array<struct<text:string,instruction:boolean,placeholder:boolean>>")),
            settled(F.col("_pieces"), at_end),
        ),
    )
    return compute_once(pieces, length=total_length(F.col("pieces"), specs)).select(key, order, "pieces", "length")


def with_offsets(turns: DataFrame, key: str, order: str, length: str = "length", out: str = "start", block: int = BLOCK_TURNS) -> DataFrame:
    """Add the sum of ``length`` over the earlier turns of the chat.

    First over whole blocks of turns (a short list per chat), then inside a block, so no window holds a whole chat.
    """
    blocked = turns.withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocked.groupBy(key, "_block").agg(F.sum(length).alias("_sum"))
    bases = bases.select(key, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = blocked.join(bases, [key, "_block"])
    return joined.withColumn(
        out, (F.col("_base") + F.coalesce(F.sum(length).over(inside), F.lit(0))).cast("bigint")
    ).drop("_block", "_base")


def piece_offsets(encodable: DataFrame, key: str, order: str, specs: Sequence[ModalitySpec]) -> DataFrame:
    """``(key, piece, instruction, length, offset)``: number and first position of every piece in the encoded sequence.

    Pieces and positions of earlier turns are running sums over blocks of turns; inside a turn a window counts on. A piece
    lies in one turn.
    """
    sized = F.transform("pieces", lambda p: F.struct(chat.piece_length(p, specs).cast("bigint").alias("length"), p["instruction"].alias("instruction")))
    turns = encodable.select(key, order, "length", sized.alias("_p"), F.size("pieces").cast("bigint").alias("_n"))
    placed = with_offsets(with_offsets(turns, key, order), key, order, "_n", "_first")
    pieces = placed.select(key, order, "start", "_first", F.posexplode("_p").alias("_i", "p"))
    before = Window.partitionBy(key, order).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("p.length").over(before), F.lit(0))
    return pieces.select(
        key, (F.col("_first") + F.col("_i")).alias("piece"), "p.instruction", "p.length", (F.col("start") + inside).cast("bigint").alias("offset")
    )


def turn_tokens(encodable: DataFrame, key: str, order: str, specs: Sequence[ModalitySpec]) -> DataFrame:
    """``(key, order, at, token, code, trained)``: one row per position, ``at`` counted from the turn's start."""
    return encodable.select(key, order, F.posexplode(chat.piece_tokens(F.col("pieces"), specs)).alias("at", "t")).select(
        key, order, F.col("at").cast("bigint").alias("at"), "t.token", "t.code", "t.trained"
    )


def encode_turns(
    encodable: DataFrame, key: str, order: str, specs: Sequence[ModalitySpec], vocab: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """``(key, order, start, input_ids, labels)``: the chat's sequence in one piece per turn.

    Putting the pieces of a chat one after the other by ``start`` gives exactly what ``encode_chat`` gives. Pass a
    staged ``encodable``; it is read for the offsets and for the tokens.
    """
    ids = attach_ids(turn_tokens(encodable, key, order, specs), vocab, max_broadcast_bytes)
    label = F.when(F.col("trained"), F.col("token_id")).otherwise(F.lit(fv.IGNORE_INDEX).cast("bigint"))
    packed = ids.groupBy(key, order).agg(
        F.array_sort(F.collect_list(F.struct("at", "token_id", label.alias("label")))).alias("_s")
    )
    starts = with_offsets(encodable.select(key, order, "length"), key, order)
    return packed.join(starts, [key, order]).select(
        key,
        order,
        "start",
        F.transform("_s", lambda s: s["token_id"]).alias("input_ids"),
        F.transform("_s", lambda s: s["label"]).alias("labels"),
    )


def code_sequences(encodable: DataFrame, key: str, order: str, specs: Sequence[ModalitySpec]) -> DataFrame:
    """``(key, order, start, input_ids)`` in which every word counts as unknown.

    Enough to find and fill spans: no vocabulary, no lookup and no regrouping of words.
    """
    starts = with_offsets(encodable.select(key, order, "length", "pieces"), key, order)

    def ids(p: Column) -> Column:
        code = F.coalesce(chat.code_of(p["text"], specs), F.lit(UNK_ID).cast("bigint"))
        return F.array_repeat(code, chat.piece_length(p, specs).cast("int"))

    return starts.select(key, order, "start", F.flatten(F.transform("pieces", ids)).alias("input_ids"))


def turn_spans(
    encoded: DataFrame, key: str, order: str, specs: Sequence[ModalitySpec], ids: str = "input_ids", start: str = "start"
) -> DataFrame:
    """``(key, name, k, start, width)`` from sequences in one piece per turn, as ``find_spans`` gives for whole ones.

    Instruction marks separate the placeholders of two turns, so a span never crosses turns; the ordinal of an item
    is its ordinal in the turn plus the number of items in earlier turns.
    """
    keyed = encoded.withColumn("_turn", F.struct(key, order))
    found = find_spans(keyed, "_turn", specs, ids).select(
        F.col("_turn")[key].alias(key), F.col("_turn")[order].alias(order), "name", "k", F.col("start").alias("_at"), "width"
    )
    counts = found.groupBy(key, "name", order).agg(F.count(F.lit(1)).alias("_n")).withColumn("_owner", F.struct(key, "name"))
    before = with_offsets(counts, "_owner", order, "_n", "_before").select(key, "name", order, "_before")
    placed = found.join(before, [key, "name", order]).join(encoded.select(key, order, F.col(start).alias("_start")), [key, order])
    return placed.select(
        key, "name", (F.col("k") + F.col("_before")).alias("k"), (F.col("_start") + F.col("_at")).alias("start"), "width"
    )


def positions(encodable: DataFrame, key: str, order: str, specs: Sequence[ModalitySpec]) -> DataFrame:
    """``(key, pos, token, code, trained)`` with ``pos`` counted from the start of the chat."""
    starts = with_offsets(encodable.select(key, order, "length", "pieces"), key, order)
    tokens = starts.select(
        key, "start", F.posexplode(chat.piece_tokens(F.col("pieces"), specs)).alias("at", "t")
    )
    return tokens.select(
        key, (F.col("start") + F.col("at")).alias("pos"), "t.token", "t.code", "t.trained"
    )
