r"""Sentence ends learned from the texts themselves.

A period ends a sentence unless it belongs to an abbreviation. Which words are abbreviations shows in their counts, in any
language (Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection", 2006): a word that nearly always has its
period, is short, and has periods inside. Three tables are learned, each from counts that combine in the tasks:

- **abbreviations**: words whose log-likelihood ratio of "always with a period" against "a period by chance", weighed by
  length, inner periods and occurrences without, is at least ``ABBREVIATION``;
- **starters**: words that follow a sure sentence end far more often than chance;
- **collocations**: a word with a period and the next one, if they meet far more often than chance (``No. 5``, ``z. B.``).

A period within a collocation is no end; one of an abbreviation is an end only before a capitalised starter; every other
is, and so are ``!`` and ``?``. Applying the model looks at a text alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import strip
from chatloom.session import stage

# fixed values: thresholds of the method
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
ALWAYS = 0.99  # how often an abbreviation has its period

MOST_ENTRIES = 200_000  # of a model in all: it is part of the plan
ENDS = r"(?<=[.!?])\s+"
BLANKS = " \n\t\r\f\v"  # what \s is
OPENING, CLOSING, MARKS = "\"'([{«„“‘", "\"')]}»”’,;:", ".!?"
LETTER = r"\p{L}"


@dataclass(frozen=True)
class SentenceModel:
    abbreviations: frozenset[str] = field(default_factory=frozenset)
    starters: frozenset[str] = field(default_factory=frozenset)
    collocations: frozenset[tuple[str, str]] = field(default_factory=frozenset)


def bare(token: Column) -> Column:
    """A token without quotes and brackets around it."""
    return F.rtrim(F.ltrim(token, F.lit(OPENING)), F.lit(CLOSING))


def lowered(token: Column) -> Column:
    """A bare token in lower case, without the marks at its end."""
    return F.lower(F.rtrim(token, F.lit(MARKS)))


def named(word: Column) -> Column:
    """``#`` for what has no letter."""
    return F.when(word.rlike(LETTER), word).otherwise("#")


def _tokens(docs: DataFrame, text: str) -> DataFrame:
    """``word``, ``dot``, ``mark`` (ends in ! or ?) of tokens, at a candidate for an end the ``next`` word, and their number ``n``.

    Tokens without a letter count as ``#``. Tokens are counted as they are written, which combines in the tasks; what they
    stand for is worked out once for each way of writing, so rows may be equal but for ``n``.
    """
    listed = docs.filter(F.col(text).isNotNull()).select(F.split(F.col(text), r"\s+", -1).alias("own"))
    zipped = F.arrays_zip("own", F.slice("own", F.lit(2), F.size("own")).alias("follows"))
    own = F.col("own")
    marked = own.contains(".") | own.contains("!") | own.contains("?")
    pairs = listed.select(F.explode(zipped).alias("p")).select("p.*").filter(own != "").select("own", F.when(marked, F.col("follows")).alias("follows"))
    written = pairs.groupBy("own", "follows").agg(F.count(F.lit(1)).alias("n"))
    after = F.when(F.col("follows") != "", bare(F.col("follows")))  # the text's end may leave an empty one
    forms = written.select(bare(own).alias("own"), after.alias("follows"), "n")
    kinds = forms.select(
        lowered(own).alias("word"), own.endswith(".").alias("dot"), (own.endswith("!") | own.endswith("?")).alias("mark"), lowered(F.col("follows")).alias("next"), "n"
    )
    following = F.when((F.col("dot") | F.col("mark")) & F.col("next").isNotNull(), named(F.col("next")))
    return kinds.select(named(F.col("word")).alias("word"), "dot", "mark", following.alias("next"), "n")


def _times_log(n: Column, p: Column) -> Column:
    """n ln p, 0 where n is 0."""
    return F.when(n > 0, n * F.log(p)).otherwise(F.lit(0.0))


def _binomial(k: Column, n: Column, p: Column) -> Column:
    return _times_log(k, p) + _times_log(n - k, 1 - p)


def abbreviation_score(dotted: Column, plain: Column, word: Column, chance: Column) -> Column:
    count = dotted + plain
    ratio = -2 * (_binomial(dotted, count, chance) - _binomial(dotted, count, F.lit(ALWAYS)))
    letters = F.length(F.replace(word, F.lit("."), F.lit(""))).cast("double")
    inner = F.length(word) - letters
    return ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -plain.cast("double"))


def association(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Log-likelihood ratio of b depending on a: ``a``, ``b``, ``both`` of ``n`` occurrences."""
    p, with_a, without_a = b / n, both / a, F.try_divide(b - both, n - a)
    return -2 * (
        _binomial(both, a, p) + _binomial(b - both, n - a, p) - _binomial(both, a, with_a) - _binomial(b - both, n - a, F.coalesce(without_a, F.lit(0.0)))
    )


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """``word, score`` of the words that occur with a period; ``counts`` has (word, dotted, plain)."""
    row = counts.agg(F.sum("dotted").alias("dotted"), F.sum(F.col("dotted") + F.col("plain")).alias("n")).first()
    chance = F.lit((row["dotted"] or 0) / max(row["n"] or 1, 1))
    scored = counts.filter((F.col("dotted") > 0) & (F.col("word") != "#"))
    return scored.select("word", abbreviation_score(F.col("dotted"), F.col("plain"), F.col("word"), chance).alias("score"))


def word_counts(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(``word, dotted, plain`` of each word; ``word, dot, mark, next, n`` of words with what follows an end), both staged.

    The texts are cut into tokens once: the first are sums over the second, of which several rows may count the same.
    """
    pairs = stage(_tokens(docs, text), "neighbours")
    sums = pairs.groupBy("word").agg(
        F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("dotted"), F.sum(F.when(~F.col("dot"), F.col("n")).otherwise(0)).alias("plain")
    )
    return stage(sums, "words"), pairs


def starter_scores(words: DataFrame, pairs: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """``next, score`` of the words that follow sure sentence ends; ``abbreviations`` has (word)."""
    breaks = F.col("mark") | (F.col("dot") & F.col("_short").isNull() & (F.col("word") != "#"))  # a number's period may be an ordinal's
    marked = pairs.filter("dot OR mark").join(abbreviations.withColumn("_short", F.lit(True)), "word", "left").filter(breaks)
    row = words.agg(F.sum(F.col("dotted") + F.col("plain")).alias("n")).first()
    ends = marked.agg(F.sum("n").alias("n")).first()["n"] or 1
    after = marked.filter(F.col("next").rlike(LETTER)).groupBy("next").agg(F.sum("n").alias("both"))
    counted = after.join(words.select(F.col("word").alias("next"), (F.col("dotted") + F.col("plain")).alias("count")), "next")
    n, a, count = F.lit(row["n"] or 1), F.lit(ends), F.col("count")
    more = n / a > count / F.col("both")
    return counted.filter(more).select("next", association(a, count, F.col("both"), n).alias("score"))


def collocation_scores(words: DataFrame, pairs: DataFrame, abbreviations: DataFrame, starters: DataFrame) -> DataFrame:
    """``word, next, score``: an abbreviation or a number with its period and the word after it, met at least twice."""
    n = F.lit(words.agg(F.sum(F.col("dotted") + F.col("plain")).alias("n")).first()["n"] or 1)
    met = pairs.filter(F.col("dot") & F.col("next").rlike(LETTER)).groupBy("word", "next").agg(F.sum("n").alias("both")).filter("both > 1")
    met = met.join(abbreviations.select("word"), "word", "left_semi").unionByName(met.filter("word = '#'")).join(starters.select("next"), "next", "left_anti")
    counted = met.join(words.select("word", F.col("dotted").alias("a")), "word").join(
        words.select(F.col("word").alias("next"), (F.col("dotted") + F.col("plain")).alias("b")), "next"
    )
    a, b, both = F.col("a"), F.col("b"), F.col("both")
    return counted.filter(n / a > b / both).select("word", "next", association(a, b, both, n).alias("score"))


def learn_sentences(docs: DataFrame, text: str) -> SentenceModel:
    """The model of all texts of ``docs``; NULL texts count nothing.

    Tables of counts stay distributed; what passes the thresholds is collected, and a model of more than ``MOST_ENTRIES``
    entries is refused: its texts are no natural language.
    """
    words, pairs = word_counts(docs, text)
    abbreviations = stage(abbreviation_scores(words).filter(F.col("score") >= ABBREVIATION), "abbreviations")
    starters = stage(starter_scores(words, pairs, abbreviations.select("word")).filter(F.col("score") >= STARTER), "starters")
    collocations = collocation_scores(words, pairs, abbreviations, starters).filter(F.col("score") >= COLLOCATION)

    def rows(df: DataFrame, *columns: str) -> list:
        found = df.select(*columns).limit(MOST_ENTRIES + 1).collect()
        if len(found) > MOST_ENTRIES:
            raise ValueError(f"more than {MOST_ENTRIES} entries")
        return found

    return SentenceModel(
        frozenset(r[0] for r in rows(abbreviations, "word")),
        frozenset(r[0] for r in rows(starters, "next")),
        frozenset((r[0], r[1]) for r in rows(collocations, "word", "next")),
    )


def _among(value: Column, values: frozenset[str]) -> Column:
    return value.isin(sorted(values)) if values else F.lit(False)


def _last_token(sentence: Column) -> Column:
    """Of a sentence that ends in no blank: searched from its end by bytes, whatever its length."""
    for blank in BLANKS:
        sentence = F.substring_index(sentence, blank, -1)
    return sentence


def sentence_splitter(model: SentenceModel) -> Callable[[Column], Column]:
    """A function that cuts a text column into its sentences.

    Blanks where a candidate for an end turned out to be none become one blank; the rest of a sentence is as written. What
    follows a candidate is looked at only if the model knows the word before. Every step is an array of its own, so that
    nothing is worked out twice.
    """
    joined = frozenset(f"{a} {b}" for a, b in model.collocations)
    suspects = model.abbreviations | {a for a, _ in model.collocations}

    def held(j: Column) -> Column:
        begins = j["capital"] & _among(j["next"], model.starters)
        return _among(F.concat_ws(" ", j["word"], j["next"]), joined) | (_among(j["word"], model.abbreviations) & ~begins)

    def inner_ends(p: Column) -> Column:
        """How many pieces there are up to each end but the last. A piece ends in a mark, so nothing closes it."""
        own = F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda s: F.when(s.endswith("."), lowered(F.ltrim(_last_token(s), F.lit(OPENING)))))
        words = F.transform(own, lambda w: F.when(w.isNotNull(), named(w)))
        first = lambda s: bare(F.regexp_extract(s, r"\A(\S+)", 1))
        known = F.transform(words, lambda w, i: F.struct(w.alias("word"), F.when(_among(w, suspects), first(F.get(p, i + 1))).alias("follows")))
        low = F.transform(
            known, lambda k: F.when(k["follows"].isNotNull(), F.struct(k["word"], lowered(k["follows"]).alias("next"), k["follows"].rlike(r"\A\p{Lu}").alias("capital")))
        )
        joints = F.transform(low, lambda j: F.when(j.isNotNull(), F.struct(j["word"], named(j["next"]).alias("next"), j["capital"])))
        return F.filter(F.transform(joints, lambda j, i: F.when(j.isNull() | ~held(j), i + 1)), lambda i: i.isNotNull())

    def cut(p: Column) -> Column:
        def between(ends: Column) -> Column:
            def sentence(a: Column, k: Column) -> Column:
                n = F.coalesce(F.get(ends, k), F.size(p)) - a
                return F.when(n == 1, F.get(p, a)).otherwise(F.array_join(F.slice(p, a + 1, n), " "))

            return F.transform(F.concat(F.array(F.lit(0)), ends), sentence)

        # a list of one, so that the ends are found once
        return F.flatten(F.transform(F.array(inner_ends(p)), between))

    def split(text: Column) -> Column:
        pieces = F.filter(F.split(strip(text), ENDS, -1), lambda s: s != "")
        return F.flatten(F.transform(F.array(pieces), lambda p: F.when(F.size(p) < 2, p).otherwise(cut(p))))

    return split
