import zlib

import numpy as np
import pytest
from fixtures import edge_docs, edge_rows, no_docs
from pyspark.sql import functions as F

from chatloom.llm import language
from chatloom.llm.language import BUCKETS, SMOOTHING, grams, held_out, identify, infer, learn, mixture

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def model(docs):
    return learn(docs.filter(~held_out(F.col("doc_id"))).select("lang", "text"))


def test_model_counts_every_learning_text(docs, model):
    rows = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    assert model.languages == sorted({r["lang"] for r in rows})
    for i, lang in enumerate(model.languages):
        own = sum(np.bincount(grams(r["text"]), minlength=BUCKETS) for r in rows if r["lang"] == lang)
        want = np.log((own + SMOOTHING) / (own.sum() + SMOOTHING * BUCKETS))
        assert np.allclose(model.logs[i], want, atol=1e-5)


def test_held_out_accuracy(docs, model):
    found = identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out(F.col("doc_id")))
    row = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")).alias("a"), F.min("score").alias("l"), F.max("score").alias("h")).first()
    assert row["a"] >= 0.99 and 0 < row["l"] and row["h"] <= 1


def test_mixtures_are_seen(docs, model):
    texts = {lang: " ".join(r["text"] for r in docs.filter((F.col("lang") == lang) & held_out(F.col("doc_id")) & (F.length("text") > 800)).limit(3).collect())[:3000] for lang in ("en", "de", "fr")}
    both = dict(infer(model, texts["en"][:2000] + " " + texts["fr"][:1000]))
    assert set(both) == {"en", "fr"} and 0.5 < both["en"] < 0.8
    assert [x[0] for x in infer(model, texts["de"])] == ["de"]


def test_shares_are_the_likeliest():
    rng = np.random.default_rng(2)
    likelihood = rng.dirichlet(np.ones(200), 3).T.T
    counts = rng.multinomial(20_000, np.array([0.6, 0.3, 0.1]) @ likelihood).astype(float)
    shares, fit = mixture(likelihood, counts)
    assert np.allclose(shares, [0.6, 0.3, 0.1], atol=0.04)
    for _ in range(50):
        other = np.clip(shares + rng.normal(0, 0.02, 3), 1e-6, None)
        assert counts @ np.log(other / other.sum() @ likelihood) <= fit + 1.0


def test_edges(spark, model):
    rows = edge_rows() + [(800, "123 !? ²", "en", "a", 1), (801, "Ⅷ", "en", "a", 1), (802, "a", None, None, 1)]
    got = identify(edge_docs(spark, rows), model).collect()
    assert len(got) == len(rows)
    letters = {str(r[0]): any(map(str.isalpha, r[1] or "")) for r in rows if r[0] is not None}
    for r in got:
        assert 0 <= r["score"] <= 1 and abs(sum(x["share"] for x in r["languages"]) - (r["lang_pred"] != "und")) < 1e-6
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not letters[str(r["doc_id"])])
    assert identify(no_docs(spark), model).count() == 0


def test_nothing_to_learn_from(spark):
    empty = learn(no_docs(spark).select("lang", "text"))
    assert empty.languages == []
    docs = spark.createDataFrame([(1, "text")], "doc_id bigint, text string")
    assert identify(docs, empty).first()["lang_pred"] == "und"


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        learn(spark.createDataFrame([(x, "some text") for x in "abc"], "lang string, text string"))


def test_halves_by_checksum(spark):
    got = spark.createDataFrame([(i,) for i in (*range(50), None)], "doc_id bigint").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_all_languages_of_a_document_are_found():
    rng = np.random.default_rng(8)
    spoken = [["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(60)] for _ in range(9)]
    text = [" ".join(rng.choice(words, 400)) for words in spoken]
    own = np.array([np.bincount(grams(t), minlength=BUCKETS) for t in text])
    model = language.Model([f"l{i}" for i in range(9)], np.log((own + SMOOTHING) / (own.sum(1, keepdims=True) + SMOOTHING * BUCKETS)))
    for n in (1, 3, 5, 7, 9):
        found = dict(infer(model, " ".join(" ".join(rng.choice(words, 100)) for words in spoken[:n])))
        assert set(found) == {f"l{i}" for i in range(n)}
        assert all(abs(share - 1 / n) < 0.05 for share in found.values())
