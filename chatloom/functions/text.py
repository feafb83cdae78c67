"""Text expressions with the meaning of the usual Python string methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom import fixed_values as fv
from chatloom.functions.hashing import coin, pick_index, pick_one

# Every character Python's str.strip() removes
_BLANK = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def strip(text: Column) -> Column:
    """Remove blanks and line breaks from both ends (plain ``trim`` would leave the line breaks)."""
    return F.btrim(text, F.lit(_BLANK))


def replace_literal(text: Column, old: str, new: Column | str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new) if isinstance(new, str) else new)


def count_literal(text: Column, needle: str) -> Column:
    """How often ``needle`` occurs without overlap."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / F.lit(len(needle))).cast("bigint")


def pick_template(key: Column, phrases: list[str], salt: str = "template") -> Column:
    return pick_one(key, salt, phrases)


def expand_items(text: Column, token: str, n: Column) -> Column:
    """Replace the item slot by ``token`` repeated once per item."""
    return F.replace(text, F.lit(fv.ITEM_SLOT), F.repeat(F.lit(token), n.cast("int")))


def place_tokens(key: Column, question: Column, token: str, n: Column, salt: str = "place") -> Column:
    """Put the tokens of all items before or after the question, by a coin per row."""
    tokens = F.repeat(F.lit(token), n.cast("int"))
    return F.when(coin(key, salt), F.concat(tokens, F.lit(" "), question)).otherwise(
        F.concat(question, F.lit(" "), tokens)
    )


def normalize_role(role: Column) -> Column:
    """``gpt``/``human`` to ``assistant``/``user``; any other value gives NULL."""
    out = F.lit(None).cast("string")
    for alias, name in fv.ROLE_ALIASES.items():
        out = F.when(role == alias, F.lit(name)).otherwise(out)
    return out


def wording_kind(key: Column, salt: str = "wording") -> Column:
    return pick_index(key, salt, len(fv.WORDING_KINDS))


def reword(content: Column, kind: Column) -> Column:
    """Rewrite visual words for the row's kind, in list order, as case-sensitive substrings.

    ``<image>`` itself is set aside first and comes back as ``<imagebind>``.
    """
    out = replace_literal(content, "<image>", fv.ITEM_SLOT)
    for word, by_kind in fv.WORDING.items():
        target = F.element_at(F.array(*[F.lit(w) for w in by_kind]), (kind + 1).cast("int"))
        out = replace_literal(out, word, target)
    return replace_literal(out, fv.ITEM_SLOT, "<imagebind>")


def too_visual(path: Column, contents: Column) -> Column:
    """True if the path or any message carries a word of the exclusion list (substring, not word).

    Messages are tested one at a time so that no match spans two of them. A carriage return and a form feed count
    as the printed escapes ``\\r`` and ``\\x0c``, whose last letter can complete a word.
    """
    def printed(text: Column) -> Column:
        return F.lower(F.replace(F.replace(text, F.lit("\r"), F.lit("\\r")), F.lit("\f"), F.lit("\\x0c")))

    def hit(text: Column) -> Column:
        return reduce(lambda a, b: a | b, [text.contains(word) for word in fv.TOO_VISUAL_WORDS])

    return path.contains(fv.TOO_VISUAL_PATH) | F.exists(F.transform(contents, printed), hit)


def caption_lines(captions: Column, style: str) -> Column:
    """The caption block of a prompt, one line per caption."""
    styles = {
        "numbered": lambda c, i: F.concat(F.lit("Image "), (i + 1).cast("string"), F.lit(" - "), c),
        "caption": lambda c, i: F.concat(F.lit('Caption: "'), c, F.lit('"')),
        "plain": lambda c, i: c,
        "tags": lambda c, i: F.concat(F.lit('Tags: "'), c, F.lit('"')),
    }
    return F.array_join(F.transform(captions, styles[style]), "\n")


def build_prompt(frame: str, lines: Column, question: Column | None = None) -> Column:
    """Fill ``{captions}`` and ``{question}`` of a prompt frame and strip the result."""
    head, rest = frame.split("{captions}")
    parts = [F.lit(head), lines]
    if question is not None:
        middle, rest = rest.split("{question}")
        parts += [F.lit(middle), question]
    return strip(F.concat(*parts, F.lit(rest)))


def parse_json_fields(payload: Column, *fields: str) -> Column:
    """Struct of text fields, or NULL when the JSON is malformed or lacks one of them."""
    schema = ", ".join(f"{f} STRING" for f in fields) + ", _bad STRING"
    parsed = F.from_json(payload, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    complete = parsed["_bad"].isNull()
    for field in fields:
        complete = complete & parsed[field].isNotNull()
    return F.when(complete, F.struct(*[parsed[f].alias(f) for f in fields]))


def stable_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(text.cast("binary"), 256))


def qa_messages(question: Column, answer: Column) -> Column:
    """The two messages of a question/answer example."""
    return F.array(
        F.struct(F.lit(fv.ROLE_USER).alias("role"), question.alias("content")),
        F.struct(F.lit(fv.ROLE_ASSISTANT).alias("role"), answer.alias("content")),
    )
