import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from chatloom.operators import chunking
from chatloom.operators.sentences import (
    ABBREVIATION,
    COLLOCATION,
    STARTER,
    SentenceModel,
    _tokens,
    learn_sentences,
    sentence_splitter,
)

OPENING, CLOSING = re.compile(r"\A[\"'(\[{«„“‘]+"), re.compile(r"[\"')\]}»”’,;:]+\Z")


def bare(token):
    return CLOSING.sub("", OPENING.sub("", token))


def word(token):
    w = re.sub(r"[.!?]+\Z", "", token).lower()
    return w if any(map(str.isalpha, w)) else "#"


def times_log(n, p):
    return n * math.log(p) if n > 0 else 0.0


def binomial(k, n, p):
    return times_log(k, p) + times_log(n - k, 1 - p)


def association(a, b, both, n):
    rest = (b - both) / (n - a) if n > a else 0.0
    return -2 * (binomial(both, a, b / n) + binomial(b - both, n - a, b / n) - binomial(both, a, both / a) - binomial(b - both, n - a, rest))


def plainly(texts):
    """The same statistics over lists in one process."""
    tokens = [[bare(t) for t in re.split(r"[ \t\n\x0b\f\r]+", text) if t] for text in texts if text is not None]
    dotted, plain, ends = Counter(), Counter(), Counter()
    for line in tokens:
        for t, after in zip(line, [*line[1:], None]):
            (dotted if t.endswith(".") else plain)[word(t)] += 1
            if t.endswith((".", "!", "?")):
                ends[(word(t), t[-1] == ".", word(after) if after is not None else None)] += 1
    n = sum(dotted.values()) + sum(plain.values())
    chance = sum(dotted.values()) / n
    short = set()
    for w, k in dotted.items():
        if w != "#":
            letters, count = len(w.replace(".", "")), k + plain[w]
            ratio = -2 * (binomial(k, count, chance) - binomial(k, count, 0.99))
            if ratio * math.exp(-letters) * (len(w) - letters + 1) * float(letters) ** -plain[w] >= ABBREVIATION:
                short.add(w)
    sure, after = 0, Counter()
    for (w, dot, t), k in ends.items():
        if not dot or (w != "#" and w not in short):
            sure += k
            if t and t != "#":
                after[t] += k
    total = lambda w: dotted[w] + plain[w]
    starters = {t for t, k in after.items() if n / sure > total(t) / k and association(sure, total(t), k, n) >= STARTER}
    met = Counter()
    for (w, dot, t), k in ends.items():
        if dot and t and t != "#" and (w == "#" or w in short) and t not in starters:
            met[(w, t)] += k
    pairs = {
        (w, t) for (w, t), k in met.items()
        if k > 1 and n / dotted[w] > total(t) / k and association(dotted[w], total(t), k, n) >= COLLOCATION
    }
    return SentenceModel(frozenset(short), frozenset(starters), frozenset(pairs))


def corpus(seed=5, n=400):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("rel", "nom", "tis", "vak")]
    names = [w.capitalize() for w in words[:20]]
    out = []
    for _ in range(n):
        text = []
        for _ in range(rng.randint(1, 8)):
            sentence = [rng.choice(["The", "Then", "It"])] + [rng.choice(words) for _ in range(rng.randint(2, 9))]
            if rng.random() < 0.5:
                sentence[2:2] = rng.choice([["Dr.", rng.choice(names)], ["e.g.", rng.choice(words)], ["No.", "5."], ["(approx.", "ten)"]])
            if rng.random() < 0.2:
                sentence[3:3] = ["5.", "mai"]
            text.append(" ".join(sentence) + rng.choice([".", ".", "!", "?", '."']))
        out.append(" ".join(text))
    return out


def test_model_is_that_of_a_plain_program(spark):
    texts = corpus() + [None, "", "  ", "...", "A. B. c.", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(6)
    model = learn_sentences(df, "t")
    assert model == plainly(texts)
    assert {"dr", "e.g", "no"} <= model.abbreviations and {"the", "then", "it"} <= model.starters and ("#", "mai") in model.collocations


def test_forms_of_tokens_are_worked_out_once_for_each_way_of_writing(spark):
    """Every occurrence once went through all steps; now copies of a text only add to the counts."""
    text = '  He said "No." Then (e.g. it) left,\tat 3.14 \n pm! \n '
    once = _tokens(spark.createDataFrame([(text,), (None,)], "t string"), "t")
    often = _tokens(spark.createDataFrame([(text,)] * 50 + [(None,), ("",), (" \n",)], "t string").repartition(4), "t")
    rows = lambda df, n: sorted((r["word"], r["dot"], r["mark"], r["next"] or "", r["n"] // n) for r in df.collect())
    assert rows(often, 50) == rows(once, 1) == sorted(
        [(w, False, False, "", 1) for w in ("he", "said", "then", "it", "left", "at")]
        + [("#", False, False, "", 1), ("no", True, False, "then", 1), ("e.g", True, False, "it", 1), ("pm", False, True, "", 1)]
    )


def test_abbreviations_are_not_cut(spark):
    df = spark.createDataFrame([(t,) for t in corpus()], "t string")
    split = sentence_splitter(learn_sentences(df, "t"))
    cases = [
        ("The barel saw Dr. Barel there. Then it left.  It was\nlate! Was it?", ["The barel saw Dr. Barel there.", "Then it left.", "It was\nlate!", "Was it?"]),
        ("It cost approx. ten e.g. \n here. the end", ["It cost approx. ten e.g. here.", "the end"]),
        ("On the 5. mai it was. On the 6. june not.", ["On the 5. mai it was.", "On the 6.", "june not."]),
        ("He met the Dr. Then he left.", ["He met the Dr.", "Then he left."]),
        ("", []), (" \n ", []), (None, None), ("One", ["One"]), ("...", ["..."]), ('He said "no." Then', ['He said "no." Then']),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = rows.select("i", split(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [w for _, w in cases]


def cut_plainly(text, model):
    pieces = [p for p in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", text.strip()) if p]
    out = pieces[:1]
    for left, right in zip(pieces, pieces[1:]):
        own, follows = (bare(re.split(r"[ \t\n\x0b\f\r]", t)[i]) for t, i in ((left, -1), (right, 0)))
        pair = (word(own), word(follows))
        begins = follows[:1].isupper() and pair[1] in model.starters
        if own.endswith(".") and (pair in model.collocations or (pair[0] in model.abbreviations and not begins)):
            out[-1] += " " + right
        else:
            out.append(right)
    return out


def test_cuts_are_those_of_a_plain_program(spark):
    """All kinds of blanks, quotes and words that only a collocation knows; the ends are worked out once in the expression."""
    model = SentenceModel(frozenset({"dr", "e.g"}), frozenset({"the", "él"}), frozenset({("#", "mai"), ("no", "the"), ("no", "#")}))
    split, rng = sentence_splitter(model), random.Random(9)
    parts = ["Dr.", "dr.", '"(e.g.', "e.g.\u00a0", "No.", "5.", "mai", "The", "the", "\"The", "Él", "x!", "y?", "z.)", "...", ".", "(.", "w", "\u00a0Dr.", "日本."]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "\n", "\t", "\x0b", "\f", "\r\n", "  "]) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", split(F.col("t")).alias("s"))
    for r in rows.collect():
        assert r["s"] == cut_plainly(texts[r["i"]], model)
    assert rows._jdf.queryExecution().analyzed().toString().count(r"\p{Lu}") == 1


def test_without_a_model_every_period_ends(spark):
    df = spark.createDataFrame([("A dr. b! C",)], "t string")
    assert df.select(sentence_splitter(SentenceModel())(F.col("t")).alias("s")).first()["s"] == ["A dr.", "b!", "C"]
    assert learn_sentences(df.limit(0), "t") == SentenceModel()


def test_chunks_of_learned_sentences(spark):
    df = spark.createDataFrame([("One dr. two. Three four.",)], "t string")
    split = sentence_splitter(SentenceModel(frozenset({"dr"})))
    chunks = chunking.chunk_documents(df, "t", window=5, split=split).first()["chunks"]
    assert [c["text"] for c in chunks] == ["One dr. two.", "Three four."]


def test_a_long_text_stays_linear(spark):
    text = " ".join(f"word{i} dr. number{i}." for i in range(30_000))
    split = sentence_splitter(SentenceModel(frozenset({"dr"})))
    assert spark.createDataFrame([(text,)], "t string").select(F.size(split(F.col("t"))).alias("n")).first()["n"] == 30_000
