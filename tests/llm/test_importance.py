import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from fixtures import edge_docs, edge_rows, no_docs

from chatloom.llm import ngram_table
from chatloom.llm.importance import resample
from chatloom.llm.ngram_table import Grams, grams, hashes, intern

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, most):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def by_hand(rows, target, most=1, buckets=10_000, percent=10, least=20, seed=2024):
    made = [(key, *features(text, most)) for key, text in rows]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, _, fs in made for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text, most)[1])
    size = (sum(s.values()) + buckets) / 1.0, (sum(t.values()) + buckets) / 1.0
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * size[0] / ((s[b] + 1.0) * size[1])))
    out = []
    for key, words, fs in made:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((key, len(words), len(fs), weight, score))
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = Counter()
    for i, r in enumerate(enough):
        drawn[(*r, i + 1 if i < len(enough) * percent // 100 else None)] += 1
    return drawn + Counter((*r, None) for r in out if r[1] < least)


TARGET = ["W1 w2 w3", None, "", "w1 w2, é", "the same line again"]


@pytest.mark.parametrize("most, percent", [(1, 10), (3, 60)])
def test_edges(spark, most, percent):
    rows = edge_rows() + [(900, "A\x00b\x7fC d-e 日本 日本", "en", "a", 1), (901, "x" * 70 + " " + "x" * 71, "en", "a", 1)]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id bigint, text string")
    got = resample(edge_docs(spark, rows), target, most=most, percent=percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == by_hand([r[:2] for r in rows], TARGET, most, percent=percent)


def test_empty_tables(spark):
    target = spark.createDataFrame([], "text string")
    assert resample(no_docs(spark), target).count() == 0
    rows = edge_rows(n=30)[:30]
    assert Counter(map(tuple, resample(edge_docs(spark, rows), target).collect())) == by_hand([r[:2] for r in rows], [])


def test_hash_is_the_library_s():
    rng = random.Random(1)
    words = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in range(100) for _ in range(3)]
    data = np.frombuffer(b"".join(words) + bytes(64), np.uint8)
    size = np.array([len(w) for w in words])
    g = Grams(data, np.zeros(len(words), int), np.cumsum(size) - size, size)
    assert hashes(g).tolist() == [xxhash.xxh64_intdigest(w) for w in words]


@pytest.mark.parametrize("colliding", [False, True])
def test_table_tells_words_apart_by_their_bytes(colliding):
    """Also where all hashes are equal, and words are beginnings of one another."""
    rng = random.Random(2)
    words = [rng.choice(["a", "ab", "b" * 8, "b" * 9, "b" * 16, "c" * 40, "c" * 39 + "d", "é"]).encode() for _ in range(500)]
    size = np.array([len(w) for w in words])
    g = Grams(np.frombuffer(b"".join(words) + bytes(64), np.uint8), np.zeros(500, int), np.cumsum(size) - size, size)
    table = intern(g, np.full(500, 7, np.uint64) if colliding else None)
    slots = {w: {int(s) for x, s in zip(words, table.slot) if x == w} for w in set(words)}
    assert all(len(s) == 1 for s in slots.values()) and len(set.union(*slots.values())) == len(slots)
    assert {w: int(table.count[min(s)]) for w, s in slots.items()} == Counter(words)
    assert table.count.sum() == 500 and (table.holder >= 0).sum() == len(slots)


@pytest.mark.parametrize("most", [1, 3])
@pytest.mark.parametrize("text_bytes, block", [(8 << 20, 1 << 19), (50, 7)])
def test_runs_of_words(monkeypatch, most, text_bytes, block):
    """Every run once, none across rows, whatever the blocks; sliced columns too."""
    monkeypatch.setattr(ngram_table, "TEXT_BYTES", text_bytes)
    monkeypatch.setattr(ngram_table, "BLOCK", block)
    texts = ["Ab cd", "", "ef", "gh i  j,k l", "...", "é" * 30 + " Z " * 40, "last"]
    column = pa.array(["before", *texts, "after"]).slice(1, len(texts))
    found = [Counter() for _ in texts]
    counted = [0] * len(texts)
    for row, n, words, blocks in grams(column, most):
        counted[row : row + n] = words.tolist()
        for g in blocks:
            for r, a, z in zip(g.row.tolist(), g.start.tolist(), g.size.tolist()):
                found[row + r][g.bytes[a : a + z].tobytes().decode()] += 1
    assert found == [Counter(features(t, most)[1]) for t in texts]
    assert counted == [len(features(t, 1)[0]) for t in texts]


def test_same_draw_for_any_partitions(spark):
    docs, target = edge_docs(spark), spark.createDataFrame([("w1 w2",)], "text string")
    assert Counter(resample(docs.repartition(1), target).collect()) == Counter(resample(docs.repartition(9), target).collect())
