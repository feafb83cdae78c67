"""Encoding one turn on its own.

A chat is one text to the encoder, and a literal ``[INST]`` or ``[/INST]`` in a message changes how that text splits.
Still a turn can be encoded without its neighbours:

- A user turn starts with ``[INST]`` and ends with ``[/INST]``. Whatever came before, it is inside an instruction from
  its first character, and no mark is left open behind it. A ``[/INST]`` in its text ends the instruction early; what
  follows is no instruction.
- So an assistant turn always starts outside. If it leaves an ``[INST]`` open, the next user turn's ``[/INST]`` closes
  that: the text from the open mark on belongs to an instruction, the text before it does not.
- Only if it is the last turn nothing closes the mark. Then the whole rest of the chat behind the last closed
  instruction holds an opening mark, and all of it counts as instruction. That rest lies in the last turn or, if no
  instruction is closed there (``open_throughout``), begins in the user turn before it.

Hence a turn needs to know one thing only: whether it is touched by such an open end of its chat (``at_end``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom import fixed_values as fv
from chatloom.functions import chat
from chatloom.registry import ModalitySpec


def has_marks(content: Column) -> Column:
    return F.coalesce(content.contains(fv.INST_OPEN) | content.contains(fv.INST_CLOSE), F.lit(False))


def _labelled(text: Column, instruction: Column, at_end: Column) -> Column:
    return F.struct(text.alias("text"), instruction.alias("instruction"), at_end.alias("at_end"))


def open_throughout(content: Column) -> Column:
    """The rendered assistant turn holds an open mark and no closed instruction."""
    text = chat.render_turn(F.lit(fv.ROLE_ASSISTANT), content)
    return has_marks(content) & (F.size(chat.split_instructions(text)) == 1) & chat.is_instruction(text)


def turn_parts(role: Column, content: Column) -> Column:
    """``array<struct<text, instruction, at_end>>`` of a rendered turn.

    ``instruction`` holds in the middle of a chat, ``at_end`` where an open end touches the turn: for an assistant
    turn, if it is the last; for a user turn, if the next turn is the last and open throughout.
    """
    text, asked = chat.render_turn(role, content), role == fv.ROLE_USER
    plain = F.array(_labelled(text, asked, asked))

    def cut(part: Column, rest: Column) -> Column:
        # ``rest``: the part behind the last closed instruction of the turn
        opened, inside = F.instr(part, fv.INST_OPEN), chat.is_instruction(part)
        halves = F.array(
            _labelled(F.substring(part, F.lit(1), opened - 1), F.lit(False), F.lit(True)),
            _labelled(F.substring(part, opened, F.length(part)), F.lit(True), F.lit(True)),
        )
        whole = F.array(_labelled(part, inside, inside | (rest & asked)))
        return F.when(rest & inside & ~asked, halves).otherwise(whole)

    def split(parts: Column) -> Column:
        return F.flatten(F.transform(parts, lambda p, i: cut(p, (i == F.size(parts) - 1) & ~_closed(p))))

    # a list of one, so that the text is split once
    marked = F.element_at(F.transform(F.array(chat.split_instructions(text)), split), 1)
    return F.filter(F.when(has_marks(content), marked).otherwise(plain), lambda p: p["text"] != "")


def _closed(part: Column) -> Column:
    return part.startswith(fv.INST_OPEN) & part.endswith(fv.INST_CLOSE)


def turn_pieces(parts: Column, specs: Sequence[ModalitySpec]) -> Column:
    """``array<struct<text, instruction, at_end, placeholder>>`` from the parts of a turn."""
    tokens = [s.token for s in specs]

    def cut(part: Column) -> Column:
        return F.transform(
            chat.split_placeholders(part["text"], specs),
            lambda t: F.struct(
                t.alias("text"),
                part["instruction"].alias("instruction"),
                part["at_end"].alias("at_end"),
                t.isin(*tokens).alias("placeholder"),
            ),
        )

    return F.flatten(F.transform(parts, cut))


def settled(pieces: Column, at_end: Column) -> Column:
    """``array<struct<text, instruction, placeholder>>`` once it is known whether an open end touches the turn."""
    return F.transform(
        pieces,
        lambda p: F.struct(
            p["text"].alias("text"),
            F.when(at_end, p["at_end"]).otherwise(p["instruction"]).alias("instruction"),
            p["placeholder"].alias("placeholder"),
        ),
    )


def begin_piece() -> Column:
    """The begin marker, a trained piece in front of the first turn."""
    return F.struct(F.lit(fv.BOS).alias("text"), F.lit(False).alias("instruction"), F.lit(False).alias("placeholder"))


def stray(pieces: Column, label: str = "instruction") -> Column:
    """A placeholder outside an instruction."""
    return F.exists(pieces, lambda p: p["placeholder"] & ~p[label])


def piece_sizes(pieces: Column, specs: Sequence[ModalitySpec]) -> Column:
    """``array<struct<n, instruction, at_end>>``: the positions each piece fills."""
    return F.transform(
        pieces,
        lambda p: F.struct(
            chat.piece_length(p, specs).cast("bigint").alias("n"),
            p["instruction"].alias("instruction"),
            p["at_end"].alias("at_end"),
        ),
    )


def size_sum(sizes: Column, label: str, masked: bool) -> Column:
    """Positions that are masked (or trained) by a label."""
    return F.aggregate(
        sizes, F.lit(0).cast("bigint"), lambda acc, s: acc + F.when(s[label] == F.lit(masked), s["n"]).otherwise(0)
    )


def total_length(pieces: Column, specs: Sequence[ModalitySpec]) -> Column:
    return F.aggregate(
        pieces, F.lit(0).cast("bigint"), lambda acc, p: acc + chat.piece_length(p, specs).cast("bigint")
    )
