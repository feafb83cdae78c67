import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatloom.operators.subwords import KnownWords, _ids_of, encode_subwords, load_ranks, split_word

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_words_as_by_plain_merging(ranks):
    """The lowest pair of all neighbours, searched anew each time."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abethingsé日 0", k=rng.randint(0, 25))).encode() for _ in range(200)] + [b"", b"a" * 300, bytes(range(256))]
    for word in words:
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            known = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not known:
                break
            _, i = min(known)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert split_word(word, ranks) == [ranks[p] for p in parts]


def test_a_long_word_stays_near_linear(ranks):
    assert len(split_word(b"xq" * 200_000, ranks)) > 1000


@pytest.mark.parametrize("limit", [256 << 20, 2000])
def test_texts_as_by_the_library(spark, ranks, library, limit):
    odd = [None, "", " ", "I'll  go,\n\n  they've\t gone ", "a b  c", "𝄞 é́ 日本語 ١٢٣ x²", "don't DON'T", "\r\n", "<|endoftext|>"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = {r["doc_id"]: r["ids"] for r in encode_subwords(docs, "doc_id", "text", ranks, max_broadcast_bytes=limit).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        assert got[k] == library(t), t[:80]


def test_empty_table_and_missing_bytes(spark, ranks, tmp_path):
    none = spark.createDataFrame([], "k long, t string")
    assert encode_subwords(none, "k", "t", ranks).count() == 0
    (tmp_path / "v").write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        load_ranks(str(tmp_path / "v"))


def test_nothing_is_exchanged_for_occurrences(spark, ranks, library):
    """Every occurrence of a word once went through two exchanges, and rows of one key were put into one list."""
    rows = [(1, "to be or not to be"), (1, "be"), (2, None), (None, " to")]
    found = encode_subwords(spark.createDataFrame(rows, "k long, t string"), "k", "t", ranks)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r["k"]), r["ids"]) for r in found.collect()) == sorted((str(k), library(t or "")) for k, t in rows)


def test_rows_of_a_batch_and_words_that_are_forgotten(ranks, library):
    """A slice of a batch whose lists do not begin at zero, an empty one, and no room to remember."""
    texts = [["a", " few"], [], [" words", " words", " undivided"], [""], [" few", "x" * 5000]]
    for most in (0, 600, 1 << 20):
        known = KnownWords(ranks, most)
        for at, n in ((0, 5), (2, 3), (1, 1), (0, 0)):
            got = _ids_of(pa.array(texts, pa.list_(pa.string())).slice(at, n), known)
            assert got.to_pylist() == [[i for w in words for i in split_word(w.encode(), ranks)] for words in texts[at : at + n]]
            assert known.used <= most


def test_query_is_the_operator_over_all_documents(spark, library):
    from chatloom.plans import all_queries

    got = {r["doc_id"]: (r["n_ids"], r["ids_md5"]) for r in all_queries()["subword_ids"](spark, SF).collect()}
    import hashlib

    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids = library(r["text"])
        assert got[r["doc_id"]] == (len(ids), hashlib.md5(" ".join(map(str, ids)).encode()).hexdigest())
