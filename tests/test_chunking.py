import random

from pyspark.sql import functions as F

from chatloom.operators import chunking


def brute(sizes, window):
    chunks = [[]]
    for n in sizes:
        if sum(chunks[-1]) + n > window:
            chunks.append([])
        chunks[-1].append(n)
    return chunks


def packed(spark, cases, window):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, n array<int>")
    return [r["p"] for r in df.select("i", chunking.pack_sentences(F.col("n"), window).alias("p")).orderBy("i").collect()]


def test_hand_cases(spark):
    got = packed(spark, [[3, 4, 9, 1, 2], [9, 1], []], 8)
    assert [[c["tokens"] for c in g] for g in got] == [[7, 9, 3], [0, 9, 1], [0]]


def test_packing_equals_brute_force(spark):
    rng = random.Random(7)
    cases = [[rng.choice([0, 1, 2, 5, 8, 13, 40]) for _ in range(rng.randint(0, 60))] for _ in range(200)]
    for window in (1, 8, 39, 40):
        for got, sizes in zip(packed(spark, cases, window), cases):
            want = brute(sizes, window)
            assert [c["tokens"] for c in got] == [sum(w) for w in want]
            assert [c["n"] for c in got] == [len(w) for w in want]
            assert [c["first"] for c in got] == [sum(map(len, want[:i])) for i in range(len(want))]


def test_texts(spark):
    df = spark.createDataFrame([(0, "One two. Three!  Four five six?\nSeven"), (1, ""), (2, " \n ")], "i int, t string")
    rows = chunking.chunk_documents(df, "t", window=5).orderBy("i").collect()
    assert [c["text"] for c in rows[0]["chunks"]] == ["One two. Three!", "Four five six? Seven"]
    assert [[(c["tokens"], c["text"]) for c in r["chunks"]] for r in rows[1:]] == [[(0, "")], [(0, "")]]
    assert chunking.cap_chunks(chunking.chunk_documents(df, "t", window=5), 1).count() == 2


def test_no_sentence_is_lost(spark):
    text = " ".join(f"word{i} number{i}." for i in range(3000))
    df = spark.createDataFrame([(0, text)], "i int, t string")
    chunks = chunking.chunk_documents(df, "t", window=64).first()["chunks"]
    assert " ".join(c["text"] for c in chunks) == text
    assert sum(c["tokens"] for c in chunks) == 9000 and max(c["tokens"] for c in chunks) <= 64


def test_clip_documents(spark):
    df = spark.createDataFrame([(0, ["a b c d", "e", ""]), (1, ["x y"])], "i int, d array<string>")
    rows = chunking.clip_documents(df, "d", window=3).orderBy("i").collect()
    assert [c["tokens"] for c in rows[0]["clipped"]] == [["a", "b", "c"], ["e", "[PAD]", "[PAD]"], ["[PAD]"] * 3]
    assert [c["mask"] for c in rows[0]["clipped"]] == [[1, 1, 1], [1, 0, 0], [0, 0, 0]]
    assert [c["tokens"] for c in rows[1]["clipped"]] == [["x", "y"]]
