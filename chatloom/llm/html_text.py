"""The main text of web pages by the distribution of their lines' lengths.

Markup is stripped into lines, one for each block of text. A line counts with the characters that are not in links; lines of
page furniture (navigation, asides, forms, notices, adverts, comments; told by element, role, class or id) and, on pages that mark
their article or main part, everything around it count nothing. Sums over sliding windows of lines are the distribution: the text begins
at a surge, where a window reaches the threshold, and ends at the dive, where one falls below; in a marked article any character
is a surge. Without one, the largest region is completed to the innermost division that holds its long lines, so that its short first
and last ones stay.

One pass over the rows, in Arrow batches; a page is the only thing in memory.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import whole

WINDOW = 3  # lines
SURGE, DIVE = 80, 40  # characters in a window, on pages without an article element

# fixed values: HTML's elements without content, with raw content, and those that begin a new block
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea select title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
FURNITURE = frozenset("nav aside footer form dialog menu button head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar alert".split())
MARKS = frozenset(
    "ad ads adsbygoogle adslot adunit advert advertisement advertorial adverts alert banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer gdpr header menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted "
    "promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)

CONTENT = frozenset("html body main article".split())  # furniture only where they are named as comments
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = HEADINGS | frozenset("p li dt dd dl ul ol tr td th tbody thead tfoot table caption blockquote pre figure figcaption".split())  # of a text, not its holder

ARTICLE, MAIN = 2, 1
HOLDERS = {"article": ARTICLE, "main": MAIN}

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z]", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME_PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Line:
    """A block's text; ``linked`` of its characters are in links, ``furniture`` is none of the page's own text."""

    text: str
    linked: int
    furniture: bool
    article: int  # ARTICLE, MAIN or 0: what it is in


@dataclass
class Element:
    tag: str
    furniture: bool
    article: int
    first: int  # its first line


def _named(tag: str, attributes: str) -> tuple[bool, int]:
    """(furniture, article) as the element's own name and attributes tell."""
    furniture, article = tag in FURNITURE, HOLDERS.get(tag, 0)
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "role":
            furniture, article = furniture or value.lower() in ROLES, max(article, HOLDERS.get(value.lower(), 0))
        elif name == "itemprop":
            article = ARTICLE if value == "articleBody" else article
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            furniture = True
        elif name in ("class", "id") and tag not in HEADINGS:
            parts = {p.lower() for p in NAME_PARTS.split(value)}
            marks = MARKS if tag not in CONTENT else {"comment", "comments"}
            furniture = furniture or not marks.isdisjoint(parts)
    return furniture, article


def page_lines(page: str) -> tuple[list[Line], list[tuple[int, int]]]:
    """The lines of a page without markup, and the ranges of lines that its divisions hold."""
    lines: list[Line] = []
    spans: list[tuple[int, int]] = []
    stack = [Element("", False, 0, 0)]
    open_tags: Counter[str] = Counter()
    paragraph = 0  # where in the stack an open paragraph is
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            lines.append(Line(text, min(linked, len(text)), stack[-1].furniture, stack[-1].article))
        parts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal paragraph
        for e in stack[depth:]:
            open_tags[e.tag] -= 1
            if e.tag not in PARTS and e.tag not in INLINE:
                spans.append((e.first, len(lines)))
        del stack[depth:]
        if paragraph >= depth:
            paragraph = 0

    at, pattern = 0, TAG
    while at < len(page):
        mark = MARKUP.search(page, at)
        text = html.unescape(page[at : mark.start() if mark else len(page)])
        parts.append(text)
        linked += len(text) if in_link else 0
        if not mark:
            break
        at = mark.end()
        if page[mark.start() + 1] in "!?":
            continue
        found = pattern.match(page, mark.start())
        if not found and pattern is TAG:  # a quote that never ends: from here on tags end at the first bracket
            pattern = PLAIN_TAG
            found = pattern.match(page, mark.start())
        if not found:
            break  # a tag that never ends
        at = found.end()
        ends, tag, attributes = found[1] == "/", found[2].lower(), found[3]
        if tag == "a":
            in_link = not ends
        if tag == "br":
            parts.append("\n")
        furniture, article = (False, 0) if ends or not attributes and tag in INLINE else _named(tag, attributes)
        if tag in INLINE and not (furniture or ends and open_tags[tag]):
            continue
        flush()
        if ends:
            if open_tags[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if paragraph and tag not in INLINE:
            close(paragraph)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?![a-zA-Z0-9-])[^>]*>?", re.I).search(page, at)
            if not end:
                break
            at = end.end()
        elif tag not in VOID and not attributes.endswith("/"):
            over = stack[-1]
            if tag == "header":
                furniture = True
            inside = (over.furniture and not (over.tag == "header" and over.article and tag in HEADINGS)) or furniture
            if tag == "p":
                paragraph = len(stack)
            stack.append(Element(tag, inside, max(over.article, article), len(lines)))
            open_tags[tag] += 1
    flush()
    close(1)
    return lines, spans


def regions(weights: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """[(surge, dive)]: from the first line with weight of a window that reaches the threshold to the next window below ``DIVE``;
    where the threshold is less than ``SURGE``, to the next empty window."""
    padded = np.concatenate([[0], np.cumsum(np.concatenate([weights, np.zeros(WINDOW)]))])
    sums = padded[WINDOW:] - padded[:-WINDOW]
    high, low, used = np.flatnonzero(sums >= threshold), np.flatnonzero(sums < (DIVE if threshold >= SURGE else 1)), np.flatnonzero(weights)
    low = np.append(low, len(weights))
    found, end = [], 0
    while True:
        k = np.searchsorted(high, end)
        if k == len(high):
            return found
        begin = int(used[np.searchsorted(used, high[k])])
        end = int(low[np.searchsorted(low, begin)])
        found.append((begin, end))


def main_text(page: str) -> str:
    """The text between surges and dives, one line for each block."""
    lines, spans = page_lines(page)
    marked = max((x.article for x in lines if not x.furniture), default=0)
    if marked:
        weights = np.array([len(x.text) if x.article == marked and not x.furniture else 0 for x in lines])
        kept = regions(weights, 1)
    else:
        weights = np.array([0 if x.furniture else len(x.text) - x.linked for x in lines])
        if not weights.any():
            return ""
        most = np.convolve(weights, np.ones(WINDOW)).max()
        best = max(regions(weights, min(SURGE, most)), key=lambda r: int(weights[r[0] : r[1]].sum()))
        long_ = best[0] + np.flatnonzero(weights[best[0] : best[1]] >= min(DIVE, weights[best[0] : best[1]].max()))
        around = [s for s in spans if s[0] <= long_[0] and s[1] > long_[-1] and s != (0, len(lines))]
        kept = [min(around, key=lambda s: s[1] - s[0], default=best)]
    return "\n".join(x.text for a, b in kept for x in lines[a:b] if not x.furniture and (x.article == marked or not marked))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([main_text(p) for p in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["_in", "text"])


def extract_text(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row for each page: the columns ``keep``, ``text`` (the main text's blocks, one a line) and ``n_chars``.

    Character references are decoded, white space within a block is one space, empty blocks are left out. A NULL or empty
    page, and one of nothing but furniture, has an empty text. Unclosed, unmatched and unfinished tags are read like by a
    browser; what stands in an unfinished last tag is none. Repeated rows and NULL keys pass like others, an empty table
    gives no rows, other columns are not read.
    """
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_in"), whole(F.col(f"`{html_column}`")).alias("page"))
    kind = rows.schema["_in"].dataType.simpleString()
    made = rows.mapInArrow(_extract, f"_in {kind}, text string")
    return made.select("_in.*", "text", F.length("text").cast("bigint").alias("n_chars"))
