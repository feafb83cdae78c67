"""Chat rendering, splitting and tokenizing, all within one row."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom import fixed_values as fv
from chatloom.registry import ModalitySpec


def render_turn(role: Column, content: Column, eos: str = fv.EOS) -> Column:
    """Text of one message inside the rendered chat."""
    instruction = F.concat(F.lit(fv.INST_OPEN + " "), content, F.lit(" " + fv.INST_CLOSE))
    return F.when(role == fv.ROLE_USER, instruction).otherwise(F.concat(content, F.lit(eos)))


def render_chat(messages: Column, bos: str = fv.BOS, eos: str = fv.EOS) -> Column:
    turns = F.transform(messages, lambda m: render_turn(m["role"], m["content"], eos))
    return F.concat(F.lit(bos), F.array_join(turns, ""))


def role_error(messages: Column) -> Column:
    """Reason why a chat cannot be rendered: roles must be user, assistant, user, ... from the first message on."""
    expected = F.transform(
        messages,
        lambda m, i: F.coalesce(m["role"], F.lit(""))
        == F.when(i % 2 == 0, F.lit(fv.ROLE_USER)).otherwise(F.lit(fv.ROLE_ASSISTANT)),
    )
    return F.when(~F.forall(expected, lambda ok: ok), F.lit("roles do not alternate from user"))


def _split_keeping(text: Column, delimiter: str) -> Column:
    """Cut ``text`` at every match of ``delimiter``, keep the matches as parts of their own, drop empty parts.

    One match yields the text before it and the delimiter; the end of the text closes the last part.
    """
    pattern = F.lit(rf"(?s)(.*?)({delimiter}|\z)")
    pairs = F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(1)),
        F.regexp_extract_all(text, pattern, F.lit(2)),
        lambda before, found: F.array(before, found),
    )
    return F.filter(F.flatten(pairs), lambda p: p != "")


def split_instructions(chat: Column) -> Column:
    """Parts of a rendered chat; each ``[INST]...[/INST]`` span is one part."""
    return _split_keeping(chat, r"\[INST\].*?\[/INST\]")


def is_instruction(part: Column) -> Column:
    """A part counts as instruction if it holds the opening mark, closed or not."""
    return part.contains(fv.INST_OPEN)


def split_placeholders(part: Column, specs: Sequence[ModalitySpec]) -> Column:
    if not specs:
        return F.array(part)
    return _split_keeping(part, "|".join(re.escape(s.token) for s in specs))


def part_pieces(parts: Column, specs: Sequence[ModalitySpec]) -> Column:
    """``array<struct<text, instruction, placeholder>>`` in reading order, from the parts of a chat."""
    tokens = [s.token for s in specs]

    def cut(part: Column) -> Column:
        return F.transform(
            split_placeholders(part, specs),
            lambda t: F.struct(
                t.alias("text"), is_instruction(part).alias("instruction"), t.isin(*tokens).alias("placeholder")
            ),
        )

    return F.flatten(F.transform(parts, cut))


def placeholder_error(pieces: Column) -> Column:
    """Reason for a placeholder outside an instruction."""
    stray = F.exists(pieces, lambda p: p["placeholder"] & ~p["instruction"])
    return F.when(stray, F.lit("placeholder outside an instruction"))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fv.TOKEN_PATTERN), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.size(tokenize(text))


def width_of(token: Column, specs: Sequence[ModalitySpec]) -> Column:
    out = F.lit(None).cast("int")
    for s in specs:
        out = F.when(token == s.token, F.lit(s.width)).otherwise(out)
    return out


def code_of(token: Column, specs: Sequence[ModalitySpec]) -> Column:
    out = F.lit(None).cast("bigint")
    for s in specs:
        out = F.when(token == s.token, F.lit(s.code).cast("bigint")).otherwise(out)
    return out


def piece_tokens(pieces: Column, specs: Sequence[ModalitySpec]) -> Column:
    """``array<struct<token, code, trained>>``: one entry per position of the encoded sequence.

    A placeholder fills ``width`` positions with its code; a text token has no code yet (the vocabulary gives it
    one). Only text outside instructions is trained.
    """

    def expand(p: Column) -> Column:
        filled = F.array_repeat(
            F.struct(
                F.lit(None).cast("string").alias("token"),
                code_of(p["text"], specs).alias("code"),
                F.lit(False).alias("trained"),
            ),
            width_of(p["text"], specs),
        )
        words = F.transform(
            tokenize(p["text"]),
            lambda t: F.struct(
                t.alias("token"), F.lit(None).cast("bigint").alias("code"), (~p["instruction"]).alias("trained")
            ),
        )
        return F.when(p["placeholder"], filled).otherwise(words)

    return F.flatten(F.transform(pieces, expand))


def piece_length(piece: Column, specs: Sequence[ModalitySpec]) -> Column:
    """Number of positions a piece fills."""
    return F.when(piece["placeholder"], width_of(piece["text"], specs)).otherwise(count_tokens(piece["text"]))
