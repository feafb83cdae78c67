"""Question/answer examples out of long-document sources."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom import fixed_values as fv
from chatloom.functions.text import replace_literal, stable_id, strip
from chatloom.operators.once import compute_once


def _anchored(pattern: str) -> str:
    """Match from the start of the text only; a dot is any character but a line feed.

    "Any character" is written as a dot in single-line mode: the class of a thing and its opposite means the same
    but is several times slower to match.
    """
    return rf"(?d)\A(?:{pattern})".replace(r"[\s\S]+", "(?s:.+)").replace("(?s:.+)?", "(?s:.+?)")


def _fill(template: str, group) -> Column:
    """Put captured groups where ``\\1``, ``\\2``, ... stand in a prompt."""
    parts = re.split(r"\\(\d)", template)
    return F.concat(*[group(int(p)) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p != ""])


def _first_match(text: Column, patterns: list[str]) -> Column:
    """Number of the first pattern that matches, or NULL."""
    out = F.lit(None).cast("int")
    for number in reversed(range(len(patterns))):
        out = F.when(text.rlike(_anchored(patterns[number])), F.lit(number)).otherwise(out)
    return out


def _by_match(which: str, options: list[Column]) -> Column:
    out = F.lit(None).cast("string")
    for number, option in enumerate(options):
        out = F.when(F.col(which) == number, option).otherwise(out)
    return out


def extract_paper_qa(df: DataFrame, instruction: str, input_: str, output: str) -> DataFrame:
    """Add ``id, document, prompt, answer, reject_reason`` for rows of long instructions.

    The frames are tried in order. A row that fits none uses its ``input`` as the document, if there is one; the
    item slot in the prompt marks where the document goes.
    """
    text = F.col(instruction)
    matched = compute_once(df, _which=_first_match(text, fv.PAPER_PATTERNS))

    def group(number: int):
        pattern = _anchored(fv.PAPER_PATTERNS[number])
        return lambda g: F.regexp_extract(text, pattern, g)

    count = range(len(fv.PAPER_PATTERNS))
    document = _by_match("_which", [group(i)(fv.PAPER_DOCUMENT_GROUPS[i]) for i in count])
    prompt = _by_match("_which", [_fill(fv.PAPER_PROMPTS[i], group(i)) for i in count])
    fallback = F.col("_which").isNull() & (F.coalesce(F.col(input_), F.lit("")) != "")
    return matched.select(
        *df.columns,
        stable_id(fv.PAPER_ID_PREFIX, text).alias("id"),
        F.when(fallback, F.col(input_)).otherwise(document).alias("document"),
        F.when(fallback, F.concat(text, F.lit(f" {fv.ITEM_SLOT}")))
        .otherwise(replace_literal(prompt, fv.QUESTION_LEAD, ""))
        .alias("prompt"),
        replace_literal(F.col(output), fv.ANSWER_LEAD, "").alias("answer"),
        F.when(F.col("_which").isNull() & ~fallback, "no document found").alias("reject_reason"),
    )


def _last_place(text: Column, end: Column, literal: str, floor: int) -> Column:
    """Where the last ``literal`` before ``end`` begins that has something behind it; NULL if that is before ``floor``."""
    # the last place that leaves a character behind it is the last one in the text less its last character
    searched = F.left(text, end - 1)
    after = F.when((end > floor) & searched.contains(literal), F.substring_index(searched, literal, -1))
    place = F.length(searched) - F.length(after) - len(literal)
    return F.when(place >= floor, place)


def _by_literals(df: DataFrame, text: Column, lead: str, literals: list[str], out: list[str]) -> DataFrame:
    """Columns ``out``: where the literals begin between which a pattern has greedy "one or more of anything" groups.

    Greedy groups take the last literal from the right, then the last of the one before in what is left, and so on, as
    long as every group keeps a character; each step is one scan, where a matcher would try all combinations. Only places
    are kept: the text is cut once, when it is known which frame fits.
    """
    end = F.when(text.startswith(lead), F.length(text))
    for literal, name in reversed(list(zip(literals, out))):
        df = compute_once(df, **{name: _last_place(text, end, literal, len(lead))})
        end = F.col(name)
    return df


def extract_long_qa(df: DataFrame, text: str) -> DataFrame:
    """Add ``id, document, prompt, answer, reject_reason`` for rows of long texts.

    The frames of ``fv.LONG_TEXT_PATTERNS`` are found by their literals in linear time; the first that fits counts.
    """
    source = F.col(text)
    cut = df
    for number, (lead, literals) in enumerate(_LONG_FRAMES):
        names = [f"_p{number}_{g}" for g in range(1, len(literals) + 1)]
        cut = _by_literals(cut, source, lead, literals, names)
    complete = [F.col(f"_p{n}_1") > len(lead) for n, (lead, _) in enumerate(_LONG_FRAMES)]
    which = F.lit(None).cast("int")
    for number in reversed(range(len(_LONG_FRAMES))):
        which = F.when(F.coalesce(complete[number], F.lit(False)), F.lit(number)).otherwise(which)
    matched = compute_once(cut, _which=which)

    def group(number: int):
        lead, literals = _LONG_FRAMES[number]
        begins = [F.lit(len(lead)), *[F.col(f"_p{number}_{g}") + len(x) for g, x in enumerate(literals, 1)]]
        ends = [*[F.col(f"_p{number}_{g}") for g in range(1, len(literals) + 1)], F.length(source)]
        return lambda g: strip(F.substring(source, begins[g - 1] + 1, ends[g - 1] - begins[g - 1]))

    count = range(len(_LONG_FRAMES))
    document = _by_match("_which", [group(i)(1) for i in count])
    prompt = _by_match("_which", [_fill(fv.LONG_TEXT_PROMPTS[i], group(i)) for i in count])
    answer = _by_match("_which", [group(i)(fv.LONG_TEXT_ANSWER_GROUPS[i]) for i in count])
    found = compute_once(
        matched,
        id=stable_id(fv.LONG_TEXT_ID_PREFIX, source),
        document=document,
        prompt=prompt,
        answer=replace_literal(answer, " .", "."),
    )
    out = found.select(*df.columns, "id", "document", "prompt", "answer")
    empty = (F.coalesce("document", F.lit("")) == "") | (F.coalesce("answer", F.lit("")) == "")
    return out.withColumn("reject_reason", F.when(empty, "no document found"))


def _frame(pattern: str) -> tuple[str, list[str]]:
    """(lead, literals between the groups) of a pattern whose groups all take anything."""
    lead, *rest = re.split(r"\(\[\\s\\S\]\+\)", pattern)
    assert rest and rest[-1] == "", pattern
    return re.sub(r"\\(\W)", r"\1", lead), [part.replace("\\n", "\n") for part in rest[:-1]]


_LONG_FRAMES = [_frame(p) for p in fv.LONG_TEXT_PATTERNS]
