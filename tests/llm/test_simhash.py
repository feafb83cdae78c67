import random

import numpy as np
import pytest
import xxhash
from fixtures import edge_docs, edge_rows, no_docs

from chatloom.llm.components import components
from chatloom.llm.simhash import drop_near_duplicates, links, near_duplicates


def fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    bits = np.array([[h >> i & 1 for i in range(64)] for h in hashes]).sum(0)
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(hashes))


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_edges(spark):
    rows = [r for r in edge_rows() if r[0] != 400]
    prints = [fingerprint(r[1]) for r in rows]
    union = Union()
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                union.join(a, b)
    least = {}
    for r, p in zip(rows, prints):
        root = union.find(p)
        if r[0] is not None:
            least[root] = min(r[0], least.get(root, r[0]))
    want = sorted(str((r[0], format(p, "016x"), least.get(union.find(p)))) for r, p in zip(rows, prints))
    got = near_duplicates(edge_docs(spark, rows)).collect()
    assert sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got) == want
    assert near_duplicates(no_docs(spark)).count() == 0


def test_chunks_of_long_texts_make_no_difference(spark):
    from chatloom.llm import simhash

    text = next(r[1] for r in edge_rows() if r[0] == 400) + " end" * 10_000
    words = simhash.words_of(text)
    assert len(words) > simhash.CHUNK
    assert simhash.majority(simhash.shingle_hashes(words, 3)) == fingerprint(text)


@pytest.mark.parametrize("crowded", [16, 2, 0])
def test_links_connect_what_is_near(spark, crowded):
    """Clusters around centres, some that share a whole segment, chains of two-bit steps."""
    rng = random.Random(crowded)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
        step = centre
        for _ in range(6):
            step ^= sum(1 << b for b in rng.sample(range(64), 2))
            prints.add(step)
    high = rng.getrandbits(32) << 32
    prints |= {high | rng.getrandbits(32) for _ in range(60)} | {rng.getrandbits(32) << 32 | 7 for _ in range(60)} | {0, 1, (1 << 64) - 1}
    prints = sorted(prints)
    union = Union()
    near = set()
    for i, a in enumerate(prints):
        union.find(a)
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                union.join(a, b)
                near.add((a, b))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links(spark.createDataFrame([(s,) for s in signed], "print bigint"), crowded).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    mine = Union()
    for p in prints:
        mine.find(p)
    for a, b in found:
        mine.join(a, b)
    assert {p: mine.find(p) for p in prints} == {p: union.find(p) for p in prints}
    assert len(found) <= 70 * len(prints)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(140)] + [(i, i + 1) for i in range(1000, 1060)]
    edges += [(5000, 5000 + i) for i in range(1, 400)]
    union = Union()
    for a, b in edges:
        union.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: union.find(x) for x in list(union) if union.find(x) != x}


def stay(rows):
    """The key and text that stay of each component: smallest key, NULL last; by text where rows repeat the key."""
    prints = [fingerprint(r[1]) for r in rows]
    union = Union()
    for i, a in enumerate(prints):
        union.find(a)
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                union.join(a, b)
    groups = {}
    for r, p in zip(rows, prints):
        own = xxhash.xxh64_intdigest((r[1] or "").encode(), 42)
        own = own - 2**64 if own >= 2**63 else own
        groups.setdefault(union.find(p), []).append(((r[0] is None, r[0] or 0, own), r[0], r[1] or ""))
    return sorted((str(k), t) for _, k, t in map(min, groups.values()))


def test_one_of_each_component_stays(spark):
    """Copies with a word changed in many, and unrelated texts."""
    rng = random.Random(9)
    rows = []
    for group in range(25):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(400, 900))]
        for copy in range(rng.choice([1, 2, 4])):
            text = base.copy()
            if copy:
                text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text), "en", "a", group))
    kept = drop_near_duplicates(edge_docs(spark, rows)).select("doc_id", "text").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == stay(rows)
    assert 25 <= len(kept) < len(rows)


def test_dropping_at_the_edges(spark):
    rows = [r for r in edge_rows() if r[0] != 400]
    docs = edge_docs(spark, rows)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == stay(rows)
    assert drop_near_duplicates(no_docs(spark)).count() == 0
