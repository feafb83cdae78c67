"""Quality rules whose cutoffs come with a guarantee.

Every rule measures one thing where more is worse (share of symbols, of repeated lines, ...). How much is too much is
learnt from labelled documents, for each stratum (language) by itself:

1. On one half of the labelled documents, good ones fix for each tolerated share t of a short list the rules' cutoffs:
   the least value that at most t of them reach.
2. On the other half, the holdout, a cutoff set is certified if the exact binomial probability to reject so few good
   documents, were the true rate of false rejection above ``risk``, is at most ``error`` / number of strata (Bonferroni).
   The lists are nested and tested from the mildest on, so one stratum needs no further correction.
3. Of the certified sets the mildest one that catches nearly as many bad documents as the strictest is used. A stratum
   without enough labels to certify any keeps all documents that pass the base rules.

Everything is DataFrame functions. Texts are read once; labelled documents are reduced to counts before any comparison.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chatloom.llm.common import WORD, whole
from chatloom.operators.once import compute_once
from chatloom.session import stage

# fixed values: what counts as a symbol, the base rules
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5

RULES = ("symbols", "capitals", "repeated_lines", "repeated_words", "long_words", "short_words")
TOLERATED = (0.0, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02)
RISK, ERROR, NEARLY = 0.02, 0.05, 0.95
BROADCAST_STRATA = 10_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def measure(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the counts of ``MEASURES``, ``base_failed`` and ``values``, the rules' values in whole per mille.

    The columns added before are dropped again; ``rows`` must not have columns that begin with an underscore and "q".
    """
    rows = compute_once(rows, _q_text=whole(F.col(text)))
    rows = compute_once(rows, _q_words=F.regexp_extract_all("_q_text", F.lit(WORD), F.lit(0)))
    n = F.size("_q_words")
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.array_join(F.slice("_q_words", i, F.lit(WINDOW)), " ")),
    ).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split("_q_text", "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    rows = compute_once(rows, _q_windows=windows, _q_lines=lines)
    # equal windows become neighbours; most texts have none
    pairs = F.transform("_q_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    repeats = F.size(F.array_distinct("_q_windows")) < F.size("_q_windows")
    rows = compute_once(rows, _q_sorted=F.when(repeats, F.array_sort(pairs)).otherwise(F.slice(pairs, 1, 0)))
    same = F.filter(
        "_q_sorted",
        lambda p, j: (p["w"] == F.get("_q_sorted", j - 1)["w"]) | (p["w"] == F.get("_q_sorted", j + 1)["w"]),
    )
    starts = F.array_sort(F.transform(same, lambda p: p["i"]))
    rows = compute_once(rows, _q_starts=starts)
    covered = F.aggregate(
        "_q_starts",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(s - a["last"], F.lit(WINDOW))).alias("n"), s.alias("last")),
        lambda a: a["n"],
    )

    def without(chars: str) -> Column:
        return F.length(F.translate("_q_text", chars, ""))

    counts = {
        "n_words": n,
        "word_chars": without(BLANKS),
        "n_symbols": F.length("_q_text") - without(SYMBOLS),
        "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
        "n_repeat_words": covered,
        "n_lines": F.size("_q_lines"),
        "n_capitals": F.length("_q_text") - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    }
    rows = compute_once(rows, **{name: c.cast("bigint") for name, c in counts.items()})
    rows = rows.drop("_q_text", "_q_words", "_q_windows", "_q_lines", "_q_sorted", "_q_starts")
    values = F.expr(
        """array(1000 * n_symbols div greatest(word_chars, 1), 1000 * n_capitals div greatest(word_chars, 1),
                 1000 * n_dup_lines div greatest(n_lines, 1), 1000 * n_repeat_words div greatest(n_words, 1),
                 least(1000, 10 * word_chars div greatest(n_words, 1)),
                 1000 - least(1000, 10 * word_chars div greatest(n_words, 1)))"""
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("values", values)


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(at most k of n) at ``rate``, summed downwards from the k-th term in logarithms; 1 where k is at the mean or above."""
    ratio = math.log(rate / (1 - rate))
    steps = F.sequence(F.lit(1).cast("bigint"), k)
    choose = F.when(k < 1, 0.0).otherwise(
        F.aggregate(steps, F.lit(0.0), lambda a, j: a + F.log((n - j + 1) / j))
    )
    last = F.exp(choose + k * ratio + n * math.log(1 - rate))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def down(a: Column, j: Column) -> Column:
        i = k - j + 1
        term = a["term"] * i * (1 - rate) / ((n - i + 1) * rate)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    series = F.when(k < 1, 1.0).otherwise(F.aggregate(steps, start, down, lambda a: a["sum"]))
    return F.when(k >= n * rate, 1.0).otherwise(last * series)


def learn_cutoffs(
    labelled: DataFrame, risk: float = RISK, error: float = ERROR, tolerated: tuple[float, ...] = TOLERATED, nearly: float = NEARLY
) -> DataFrame:
    """(stratum, cutoffs): for each stratum that can be certified the least value each rule rejects.

    ``labelled``: (stratum, values, good, holdout). Documents that fail the base rules don't belong in it.
    """
    labelled = stage(labelled.select("stratum", "values", "good", "holdout"), "labelled")
    fit = labelled.filter("good AND NOT holdout").select("stratum", F.posexplode("values").alias("rule", "value"))
    counts = fit.groupBy("stratum", "rule", "value").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("stratum", "rule").orderBy(F.col("value").desc())
    every = Window.partitionBy("stratum", "rule")
    reach = counts.withColumn("reached", F.sum("n").over(down)).withColumn("all", F.sum("n").over(every))
    least = [F.coalesce(F.max(F.when(F.col("reached") > t * F.col("all"), F.col("value"))) + 1, F.lit(0)) for t in tolerated]
    sets = reach.groupBy("stratum", "rule").agg(F.array(*least).alias("by_share"))
    sets = sets.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("rule", "by_share"))).alias("rules"))
    by_rank = F.transform(
        F.sequence(F.lit(0), F.lit(len(tolerated) - 1)), lambda t: F.transform("rules", lambda r: F.get(r["by_share"], t))
    )
    sets = sets.select("stratum", by_rank.alias("sets"))

    tried = labelled.filter("holdout").join(sets, "stratum")
    passes = F.filter("sets", lambda cut: ~F.exists(F.zip_with("values", cut, lambda v, c: v >= c), lambda x: x))
    tried = tried.select("stratum", "good", F.size(passes).alias("rank"))  # rejected by all sets from that one on
    grid = F.explode(F.sequence(F.lit(0), F.lit(len(tolerated) - 1)))
    ranks = tried.groupBy("stratum", "rank").agg(
        F.sum(F.col("good").cast("bigint")).alias("good"), F.sum((~F.col("good")).cast("bigint")).alias("bad")
    )
    # a row for each set, also where no document has just that rank
    empty = sets.select("stratum", grid.alias("rank"), F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("bad"))
    ranks = ranks.unionByName(empty).groupBy("stratum", "rank").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    up = Window.partitionBy("stratum").orderBy("rank")
    totals = Window.partitionBy("stratum")
    ranks = ranks.select(
        "stratum",
        "rank",
        F.sum("good").over(up).alias("false_rejections"),
        F.sum("bad").over(up).alias("caught"),
        F.sum("good").over(totals).alias("n_good"),
    ).filter(F.col("rank") < len(tolerated))
    strata = max(1, sets.count())
    certified = ranks.filter((F.col("n_good") > 0) & (binomial_tail(F.col("n_good"), F.col("false_rejections"), risk) <= error / strata))
    most = F.max("caught").over(totals)
    used = certified.withColumn("most", most).filter((F.col("caught") > 0) & (F.col("caught") >= nearly * F.col("most")))
    used = used.groupBy("stratum").agg(F.min("rank").alias("rank"))
    return stage(used.join(sets, "stratum").select("stratum", F.get("sets", F.col("rank")).alias("cutoffs")), "cutoffs")


def stratum_of(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with ``cutoffs`` (NULL where none is certified) and ``kept``."""
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    too_much = F.exists(F.zip_with("values", "cutoffs", lambda v, c: v >= c), lambda x: x)
    judged = measured.join(cutoffs, "stratum", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(too_much, F.lit(False)))


def holdout(key: Column) -> Column:
    """Half of the labelled documents, by the MD5 of the key."""
    return F.substring(F.md5(key.cast("string")), 1, 1) >= "8"


def quality_rules(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", **options
) -> DataFrame:
    """One row for each input row: ``key``, ``stratum``, the counts, ``base_failed``, ``values``, ``cutoffs``, ``kept``.

    ``labels``: (key, label) with label 1 for good and 0 for bad documents; rows with NULLs are ignored, several labels
    of one document all count. A NULL text has no words and fails the base rules. A NULL stratum is a stratum of its
    own; ``stratum`` reads "=" and the value, or is empty. Repeated rows are judged alike. Without labels, or with too
    few, only the base rules reject. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), stratum_of(F.col(f"`{stratum}`")).alias("stratum"), F.col(f"`{text}`").alias("text"))
    measured = stage(measure(rows, "text").drop("text"), "measured")
    cutoffs = cutoffs_for(measured, labels, key, label, **options)
    return judge(measured, cutoffs).withColumnRenamed("key", key)


def cutoffs_for(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", **options) -> DataFrame:
    given = labels.select(F.col(f"`{key}`").alias("key"), (F.col(f"`{label}`") == 1).alias("good")).dropna()
    labelled = measured.filter(~F.col("base_failed")).join(given, "key").withColumn("holdout", holdout(F.col("key")))
    return learn_cutoffs(labelled, **options)


def good_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", **options) -> DataFrame:
    """The rows of ``docs``, all their columns, that the rules keep.

    The rows are staged with their counts: writing them costs a fraction of counting twice.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{key}`").alias("key"),
        stratum_of(F.col(f"`{stratum}`")).alias("stratum"),
        F.col(f"`{text}`").alias("text"),
    )
    measured = stage(measure(rows, "text").drop("text"), "measured")
    cutoffs = cutoffs_for(measured.drop("row"), labels, key, label, **options)
    return judge(measured, cutoffs).filter("kept").select("row.*")
