import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from fixtures import edge_docs, edge_rows, no_docs
from pyspark.sql import functions as F

from chatloom.llm import manifest
from chatloom.llm.manifest import levels_for, merkle_manifest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """(root, siblings of each node as (before, after) for each level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            run = nodes[at[i] // 8 * 8 : at[i] // 8 * 8 + 8]
            p.append(("".join(run[: at[i] % 8]), "".join(run[at[i] % 8 + 1 :])))
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def by_hand(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: climb([made[2] for made in sorted(langs[x], key=lambda m: m[:3])]) for x in names}
    root, above = climb([trees[x][0] for x in names])
    out = Counter()
    for x, over in zip(names, above):
        subroot, paths = trees[x]
        for (_, _, own, r), path in zip(sorted(langs[x], key=lambda m: m[:3]), paths):
            again = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                again = leaf(r[0], r[1].translate(LOWER), *r[2:])
            for before, after in path + over:
                again = sha(before, again, after)
            out[(r[0], own, subroot, root, sha(*[a + b for a, b in path + over]), again, again == root)] += 1
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("digits", [4, 1])
def test_edges(spark, monkeypatch, digits):
    """Whole blocks, and one level for each round."""
    monkeypatch.setattr(manifest, "DIGITS", digits)
    rows = edge_rows() + [(1000 + i, f"Text {i}" if i % 3 else f"text {i}", f"x{i}", "S", i) for i in range(20)]
    want = by_hand(rows)
    got = Counter(map(tuple, merkle_manifest(edge_docs(spark, rows)).select(*COLUMNS).collect()))
    assert got == want
    assert {k[6] for k in want} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_sizes_of_one_group(spark, n):
    rows = [(i, "T", "en", "s", i) for i in range(n)]
    assert Counter(map(tuple, merkle_manifest(edge_docs(spark, rows)).select(*COLUMNS).collect())) == by_hand(rows)


def test_more_than_a_block(spark):
    rows = [(i, f"Text {i}", "en" if i % 3 else None, "s", i) for i in range(14_000)]
    assert Counter(map(tuple, merkle_manifest(edge_docs(spark, rows, False)).select(*COLUMNS).collect())) == by_hand(rows)


def test_empty_table(spark):
    assert merkle_manifest(no_docs(spark)).count() == 0


def test_any_other_change_shows(spark):
    """A proof holds for its own row only."""
    docs = edge_docs(spark, [(i, f"t{i}", "en", "s", i) for i in range(20)], False)
    made = merkle_manifest(docs).select("doc_id", "leaf", "path", "root")
    swapped = made.select((F.col("doc_id") + 1).alias("doc_id"), F.col("leaf").alias("other"))
    tried = made.join(swapped, "doc_id").select((manifest.folded(F.col("path"), F.col("other")) == F.col("root")).alias("ok"))
    assert {r["ok"] for r in tried.collect()} == {False}


def test_levels(spark):
    sizes = [1, 2, 8, 9, 64, 65, 8**6, 8**6 + 1, 10**12]
    df = spark.createDataFrame([(n,) for n in sizes], "n bigint").select("n", levels_for(F.col("n")).alias("levels"))
    assert dict(map(tuple, df.collect())) == dict(zip(sizes, [0, 1, 1, 2, 2, 3, 6, 7, 14]))
