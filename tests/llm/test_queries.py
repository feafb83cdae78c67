"""The registered queries themselves over whole tables, against plain programs written from their contracts."""

import ast
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_mixing import targets
from test_simhash import Union, fingerprint
from test_suffix_dedup import brute
from tokenizers import Tokenizer

import chatloom.llm.queries  # noqa: F401 - registers
from chatloom.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return QUERIES[name](spark, SF).collect()


def crc(data):
    return zlib.crc32(data) & 0xFFFFFFFF


def test_op3(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in run(spark, "op3_pack_sequences"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == documents.keys()
    for key, found in pieces.items():
        ids = np.array([*library.encode(documents[key]["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.02 * sum(n for own in sequences.values() for _, n in own) / 2048 + 12


def test_op4(spark, documents):
    union, prints = Union(), {k: fingerprint(r["text"]) for k, r in documents.items()}
    values = sorted(set(prints.values()))
    for i, a in enumerate(values):
        union.find(a)
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                union.join(a, b)
    least = {}
    for k, p in prints.items():
        least[union.find(p)] = min(k, least.get(union.find(p), k))
    want = {k: (format(p, "016x"), least[union.find(p)]) for k, p in prints.items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op4_simhash_near_dedup")} == want


def test_op5(spark, documents):
    rows = [(k, r["text"]) for k, r in documents.items()]
    want = {}
    for key, n, spans, digest in map(ast.literal_eval, brute(rows)):
        want[key] = (n, sum(e - a for a, e in spans), len(spans), digest)
    assert {r["doc_id"]: tuple(r)[1:] for r in run(spark, "op5_suffix_dedup")} == want


def test_op6(spark, documents):
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    kinds = ("assign", "access", "hex")
    for r in run(spark, "op6_secret_scan"):
        text = documents[r["doc_id"]]["text"] or ""
        spans = [(m.start(), m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
        spans.sort(key=lambda s: (s[0], kinds.index(s[2])))
        listed = [f"{k}:{a}:{b}" for a, b, k in spans]
        n = Counter(k for _, _, k in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n["assign"], n["access"], n["hex"])
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(",")) | {""}


def test_op7(spark, documents):
    size = {k: len((r["text"] or "").encode().split()) for k, r in documents.items()}
    own, taken = Counter(), Counter()
    for k, r in documents.items():
        own[r["source"]] += size[k]
    want, rows = targets(own), run(spark, "op7_mix_sources")
    assert len(rows) == len(documents)
    for r in rows:
        source = documents[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == own[source] and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(want[source])
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in own)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run(spark, "op7_mix_sources")))


def test_op8(spark, documents):
    shards = defaultdict(list)
    for r in run(spark, "op8_shard_by_bytes"):
        data = (documents[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, crc(data), "bytes", None)
        shards[r["shard"]].append(r)
    assert sum(map(len, shards.values())) == len(documents) and set(shards) <= set(range(40))
    for own in shards.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in shards.get(s, [])) for s in range(40)]
    largest = max(r["size"] for own in shards.values() for r in own)
    assert max(sizes) - sum(sizes) / 40 <= max(largest, 0.005 * sum(sizes) / 40) + 1


def test_op10(spark, documents):
    rows = run(spark, "op10_language_id")
    langs = {r["lang"] for r in documents.values() if r["lang"] is not None}
    assert {r["doc_id"] for r in rows} == documents.keys() and len(rows) == len(documents)
    for r in rows:
        text = documents[r["doc_id"]]["text"]
        assert r["held_out"] == (crc(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in langs if any(map(str.isalpha, text or "")) else r["lang_pred"] == "und"
    judged = [r["lang_pred"] == documents[r["doc_id"]]["lang"] for r in rows if r["held_out"] and documents[r["doc_id"]]["lang"]]
    assert sum(judged) >= 0.95 * len(judged)
