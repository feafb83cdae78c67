"""Small documents with everything that may go wrong, and the whole-table oracles of the queries."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ["key", "size", "shard", "slot", "kept", "node", "_t", "_in", "stratum", "values", "position", "print", "g", "owner", "spans", "rule", "host"]
SF = "/root/testdata/sf0.001"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edge_rows(seed: int = 3, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, " ".join(words(rng, rng.randrange(5, 120))), rng.choice(["en", "de"]), rng.choice(["a", "b", "z"]), 1))
    base = words(rng, 150)
    near = base.copy()
    near[70] = "changed"
    rows += [(100, " ".join(base), "en", "a", 1), (101, " ".join(near), "en", "a", 1), (102, " ".join(base), "de", "b", 1)]
    rows += [(200, None, "en", "a", None), (201, None, None, None, None), (202, "", "en", None, 0), (203, " \n\t ", "de", "b", 4)]
    rows += [(204, "é", "fr", "b", 1), (205, "x" * 49, "fr", "b", 49), (206, "日本語のテキスト " * 40, "ja", "c", 400)]
    rows += [(300, rows[5][1], "en", "a", 1)] * 2  # one row twice
    rows += [(None, rows[6][1], "en", "a", 1), (None, "only here " * 30, None, "z", 1), (None, None, None, None, None)]
    rows += [(400, " ".join(words(rng, 60_000, 30_000)), "en", "a", 1)]  # a long one
    rows += [(500 + i, "the same line again\n" * 20, "de", "b", 1) for i in range(30)]  # a hot text
    return rows


def edge_docs(spark, rows=None, clashes: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows() if rows is None else rows, SCHEMA)
    for c in CLASHES if clashes else []:
        df = df.withColumn(c, F.lit(c))
    return df.repartition(4)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
