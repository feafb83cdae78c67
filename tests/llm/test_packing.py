import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures import edge_docs, edge_rows, no_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chatloom.llm.packing import encoder, pack, shortest_pack_first, slots

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


LIBRARY = library()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t\r'sdtm0123456789abcXYZ.!<|> \u0085éß²½ºª ", max_size=80)))
def test_ids_are_the_librarys(text):
    assert encoder(PATH)(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_ids_of_documents_and_special_strings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    for text in [r["text"] for r in rows] + ["<|endoftext|> a<|endoftext|>", "".join(map(chr, range(1, 0x250)))]:
        assert encoder(PATH)(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_each_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 2048])
    histogram = {rng.randrange(1, capacity + 1): rng.choice([1, 3, 50, 10**6]) for _ in range(rng.choice([1, 5, 200]))}
    patterns = shortest_pack_first(histogram, capacity)
    held = Counter()
    for count, content in patterns:
        assert count > 0 and sum(n * times for n, times in content) <= capacity
        for n, times in content:
            held[n] += count * times
    assert held == Counter(histogram)
    assert len(patterns) <= 6 * capacity
    table = slots(patterns)
    for n in histogram:
        assert table[table[:, 0] == n][0][1] == 0


def test_small_lengths_fill_the_gaps():
    rng = random.Random(0)
    lengths = Counter(min(2048, int(rng.lognormvariate(6, 1))) or 1 for _ in range(50_000))
    packs = sum(c for c, _ in shortest_pack_first(lengths, 2048))
    assert sum(n * c for n, c in lengths.items()) >= 0.99 * 2048 * packs


@pytest.mark.parametrize("capacity", [2048, 100])
def test_edges(spark, capacity):
    rows = edge_rows()
    packed = pack(edge_docs(spark, rows), PATH, capacity=capacity)
    got = packed.pieces.join(packed.tokens, "piece").collect()
    by_sequence = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] <= capacity
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    for parts in by_sequence.values():
        end = 0
        for offset, length, _ in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    want = Counter()
    for r in rows:
        ids = np.array(LIBRARY.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        for at in range(0, len(ids), capacity):
            want[(r[0], at, zlib.crc32(ids[at : at + capacity].tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], zlib.crc32(bytes(r["ids"])), r["doc_tokens"]) for r in got) == want
    put = {r["sequence_id"]: bytes(r["ids"]) for r in packed.sequences().collect()}
    assert put == {s: b"".join(i for _, _, i in sorted(parts)) for s, parts in by_sequence.items()}


def test_empty_table(spark):
    assert pack(no_docs(spark), PATH).pieces.count() == 0


def test_added_tokens_in_texts_are_the_librarys_default(spark):
    default = Tokenizer.from_file(PATH)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "é日<|endoftext|><|endoftext|> x", "<|endoftext", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    packed = pack(docs, PATH)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packed.pieces.join(packed.tokens, "piece").collect()}
    assert got == {i: default.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    assert got[0] != LIBRARY.encode(texts[0], add_special_tokens=False).ids + [1]
