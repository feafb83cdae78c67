import math
import re

import pytest
from fixtures import edge_docs, edge_rows, no_docs
from pyspark.sql import functions as F

from chatloom.llm.quality import binomial_tail, good_documents, holdout, learn_cutoffs, quality_rules


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else _twice(windows)
    covered = {i + d for i, w in enumerate(windows) if w in twice for d in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, repeats = len(words), len(covered)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeats, n < 10 or 100 * repeats > 20 * n


def _twice(windows):
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    return twice


def test_base_counts(spark):
    rows = edge_rows() + [(600, "a b c d e a b c d e f", "en", "a", 1), (601, "x " * 8 + "## $|", "en", "a", 1), (602, "a b c d\u0085e", "en", "a", 1)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 1)], "doc_id bigint, quality int")
    got = quality_rules(edge_docs(spark, rows), labels).collect()
    assert len(got) == len(rows)
    want = sorted(str((r[0], *base(r[1]))) for r in rows)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(str(tuple(r[c] for c in names)) for r in got) == want
    assert all(r["kept"] != r["base_failed"] for r in got)  # three labels certify nothing


def test_good_documents_keep_their_columns(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not base(r[1])[5] for r in edge_rows())
    assert good_documents(no_docs(spark), labels).count() == 0
    assert quality_rules(no_docs(spark), labels).count() == 0


@pytest.mark.parametrize("n, k, rate", [(10, 0, 0.02), (500, 3, 0.02), (500, 10, 0.02), (5000, 60, 0.02), (200_000, 3_900, 0.02), (0, 0, 0.1)])
def test_binomial_tail(one, n, k, rate):
    got = one(lambda c: binomial_tail(F.col("n"), F.col("k"), rate), n=("bigint", n), k=("bigint", k))
    if k >= n * rate:
        assert got == 1.0
        return
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log(1 - rate) for i in range(k + 1)]
    assert math.isclose(got, math.fsum(map(math.exp, terms)), rel_tol=1e-6)


def test_cutoffs_keep_their_promise(spark):
    """In two strata the rule separates; in the third good documents look like bad ones, in the fourth labels are few."""
    rows = []
    for stratum, n, high in (("=a", 3000, 700), ("=b", 3000, 400), ("=c", 3000, None), ("=d", 40, 700)):
        for i in range(n):
            good = i % 5 > 0
            value = (i * 37) % 300 if good or high is None else high + (i * 37) % 100
            rows.append((stratum, [value, 0, 0, 0, 40, 960], good, i % 2 == 0))
    labelled = spark.createDataFrame(rows, "stratum string, values array<int>, good boolean, holdout boolean")
    cutoffs = {r["stratum"]: r["cutoffs"] for r in learn_cutoffs(labelled).collect()}
    assert 290 < cutoffs["=a"][0] <= 700 and 290 < cutoffs["=b"][0] <= 400 and "=d" not in cutoffs
    for stratum, cut in cutoffs.items():
        good = [r[1] for r in rows if r[0] == stratum and r[2]]
        assert sum(any(v >= c for v, c in zip(values, cut)) for values in good) <= 0.02 * len(good)


def test_halves(spark):
    share = spark.range(4000).select(holdout(F.col("id")).cast("int").alias("h")).agg(F.avg("h")).first()[0]
    assert 0.46 < share < 0.54
