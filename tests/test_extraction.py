import hashlib
import re

from chatloom import fixed_values as fv
from chatloom.operators import extraction

BODY = "Some text. With \n lines.\nMore"
PAPERS = [
    f"Below is a paper. Memorize the paper and answer my question after the paper.\n The paper begins. \n {BODY} \n Now the paper ends. \nQuestion: why?",
    f"Below is a paper. Memorize the material and answer my question after the paper.\n{BODY}\n Now the material ends. Question: why?\nQuestion: how?",
    f"There are two papers. Memorize them and answer my question after the paper.\n The first paper begins. \n {BODY} Now the second paper ends. now?",
    f"Below is some paragraphs in the book, Emma. By J. Austen. Memorize the content and answer my question after the book.\n{BODY} \n Now the material ends. who?",
    f" Below is a paper. Memorize the paper and answer my question after the paper.\n The paper begins. \n {BODY} \n Now the paper ends. \nwhy?",
    "Below is a paper! Memorize the paper and answer my question after the paper?\n The paper begins! \n x \n Now the paper ends! \ny",
    "Question: plain",
    "",
]


def test_papers_follow_the_patterns(spark):
    rows = [(i, p, inp, f"Answer: a{i} Answer: b") for i, p in enumerate(PAPERS) for inp in (None, "", "input text")]
    df = spark.createDataFrame(rows, "n int, instruction string, input string, output string")
    got = extraction.extract_paper_qa(df, "instruction", "input", "output").collect()
    for r in got:
        document = prompt = None
        for pattern, template, at in zip(fv.PAPER_PATTERNS, fv.PAPER_PROMPTS, fv.PAPER_DOCUMENT_GROUPS):
            m = re.match(pattern, r["instruction"])
            if m:
                document, prompt = m.group(at), m.expand(template).replace("Question: ", "")
                break
        if document is None and r["input"]:
            document, prompt = r["input"], r["instruction"] + f" {fv.ITEM_SLOT}"
        assert (r["document"], r["prompt"], r["reject_reason"] is None) == (document, prompt, document is not None)
        assert r["answer"] == f"a{r['n']} b"
        assert r["id"] == "longalpaca-" + hashlib.sha256(r["instruction"].encode()).hexdigest()


SEARCH = "Write a high-quality answer for the given question using only the provided search results (some of which might be irrelevant)."
LONG = [
    f"{SEARCH}\n {BODY}\nQuestion: q1 \nAnswer: short\nLong Answer: the answer .\n",
    f"{SEARCH}\n {BODY}\nQuestion: q1\nQuestion: q2\nAnswer: x Answer: y\nLong Answer: z\nLong Answer: w . .",
    f"{BODY}\nQ: q1\nQ: q2 \nA: \n a . ",
    f"{BODY}\nQ: q1\nA: \n ",
    " \nQ: q1\nA: a",
    f"{BODY}\nQ: q1",
    "",
    f"{SEARCH} no question\nQ: q\nA: a",
]


def test_long_texts_follow_the_patterns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LONG)], "n int, text string")
    for r in extraction.extract_long_qa(df, "text").collect():
        document = prompt = answer = None
        for pattern, template, at in zip(fv.LONG_TEXT_PATTERNS, fv.LONG_TEXT_PROMPTS, fv.LONG_TEXT_ANSWER_GROUPS):
            m = re.match(pattern, r["text"])
            if m:
                document = m.group(1).strip()
                prompt = template.replace("\\2", m.group(2).strip())
                answer = m.group(at).strip().replace(" .", ".")
                break
        good = bool(document and prompt and answer)
        assert (r["reject_reason"] is None) == good, r
        if good:
            assert (r["document"], r["prompt"], r["answer"]) == (document, prompt, answer)


def test_long_input_does_not_overflow(spark):
    text = "word " * 100_000
    df = spark.createDataFrame([(f"{text}\nQ: q\nA: a",), (text,)], "text string")
    got = extraction.extract_long_qa(df, "text").collect()
    assert sorted(len(r["document"] or "") for r in got) == [0, len(text.strip())]


def test_long_texts_follow_the_patterns_on_random_texts(spark):
    import random

    rng = random.Random(8)
    parts = ["Question: ", "Answer: ", "\nLong Answer: ", "\nQ: ", "\nA: ", "x", " ", "\n", "é", " ."]
    texts = ["".join([rng.choice([SEARCH, ""])] + [rng.choice(parts) for _ in range(rng.randrange(25))]) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in extraction.extract_long_qa(df, "text").collect():
        want = (None, None, None)
        for pattern, template, at in zip(fv.LONG_TEXT_PATTERNS, fv.LONG_TEXT_PROMPTS, fv.LONG_TEXT_ANSWER_GROUPS):
            m = re.match(pattern, r["text"])
            if m:
                want = (m.group(1).strip(), template.replace("\\2", m.group(2).strip()), m.group(at).strip().replace(" .", "."))
                break
        assert (r["document"], r["prompt"], r["answer"]) == want, r["text"]


def test_a_lead_without_a_long_answer_takes_linear_time(spark):
    import time

    text = SEARCH + "Question: x Answer: y " * 45_000
    begin = time.time()
    row = extraction.extract_long_qa(spark.createDataFrame([(text,)], "text string"), "text").first()
    assert row["reject_reason"] and time.time() - begin < 10
