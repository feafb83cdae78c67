"""Language identification as inference of a mixture.

Every labelled language is a distribution over hashed byte trigrams, counted over all its learning texts. A document is
taken as a mixture of languages: expectation-maximisation finds the shares that make its trigrams most likely, for each
set of the leading languages, and the set with the best likelihood less a penalty for its size (BIC) is chosen. Only the
penalty limits the size: sets grow until none of more languages can score better, whatever its shares. The language with
the largest share is the prediction.

Counts combine in the tasks and again in Spark; the model has a fixed size for each language and is all that is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM, BUCKETS = 3, 1 << 15
SMOOTHING = 0.5
MOST_LANGUAGES = 512  # 64 MiB of model
ROUNDS, SETTLED = 40, 1e-4
UNKNOWN = "und"

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def grams(text: str) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased text; all but letters are blanks, blank trigrams don't count."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    b = _TABLE[raw].astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    code = code[code != 0x202020]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


# ---- learning ----------------------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])], names=["lang", "bucket", "n"])
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if lang not in counts:
                if len(counts) == 64:
                    yield from flush()
                counts[lang] = np.zeros(BUCKETS, np.int64)
            counts[lang] += np.bincount(grams(text), minlength=BUCKETS)
    yield from flush()


def _dense(table: pa.Table) -> pa.Table:
    own = np.zeros(BUCKETS, np.int64)
    own[table["bucket"].to_numpy()] = table["n"].to_numpy()
    logs = np.log((own + SMOOTHING) / (own.sum() + SMOOTHING * BUCKETS)).astype("<f4")
    return pa.table({"lang": pa.array([table["lang"][0].as_py()]), "logs": pa.array([logs.tobytes()], pa.binary())})


@dataclass
class Model:
    """``logs[i]``: logarithm of each trigram bucket's probability in ``languages[i]``."""

    languages: list[str]
    logs: np.ndarray


def learn(texts: DataFrame) -> Model:
    """``texts``: (lang, text), all of which is counted. Rows with NULLs are ignored."""
    texts = texts.select(F.col("lang").cast("string").alias("lang"), "text").dropna()
    counts = texts.mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    dense = counts.groupBy("lang").applyInArrow(_dense, "lang string, logs binary")  # at most BUCKETS rows for each
    rows = sorted(dense.limit(MOST_LANGUAGES + 1).collect())
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    logs = np.array([np.frombuffer(r["logs"], "<f4") for r in rows]).reshape(-1, BUCKETS)
    return Model([r["lang"] for r in rows], logs)


# ---- inference ---------------------------------------------------------------------------------------------


def mixture(likelihood: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """(shares, log-likelihood): ``likelihood`` is (languages x trigrams), each column scaled to a maximum of 1."""
    k, n = len(likelihood), counts.sum()
    shares = np.full(k, 1.0 / k)
    if k == 1:
        return shares, float(counts @ np.log(likelihood[0]))
    for _ in range(ROUNDS):
        weighted = shares[:, None] * likelihood
        new = weighted @ (counts / weighted.sum(0)) / n
        settled = np.abs(new - shares).max() < SETTLED
        shares = new
        if settled:
            break
    return shares, float(counts @ np.log(shares @ likelihood))


def infer(model: Model, text: str) -> list[tuple[str, float]]:
    """[(language, share)] of the chosen set, largest share first; shares sum to 1."""
    found = np.bincount(grams(text), minlength=BUCKETS)
    used = np.flatnonzero(found)
    if not len(used) or not model.languages:
        return []
    counts = found[used].astype(np.float64)
    logs = model.logs[:, used].astype(np.float64)
    likelihood = np.exp(logs - logs.max(0))
    likelihood = np.maximum(likelihood, 1e-300)
    n = counts.sum() / GRAM  # a letter is in as many trigrams, so they count as that many fewer
    shares, fit = mixture(likelihood, counts)
    # likelihood is concave in the shares: no mixture of any languages fits better than this
    most = fit + counts.sum() * np.log(max(1.0, (likelihood @ (counts / (shares @ likelihood))).max() / counts.sum()))
    single = np.log(likelihood) @ counts
    first = int(np.argmax(single))
    order = [first, *[int(i) for i in np.argsort(-shares, kind="stable") if i != first]]
    best, chosen = -np.inf, None
    for k in range(1, len(order) + 1):
        penalty = (k - 1) * (0.5 * np.log(max(n, 2.0)) + np.log(len(model.languages)))
        if chosen and most / GRAM - penalty <= best:
            break
        members = order[:k]
        shares, fit = mixture(likelihood[members], counts)
        score = fit / GRAM - penalty
        if score > best:
            best, chosen = score, sorted(zip((-shares).tolist(), members))
    return [(model.languages[i], min(1.0, -s)) for s, i in chosen]


SHARE = pa.struct([("lang", pa.string()), ("share", pa.float64())])


def _predictor(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"lang": a, "share": s} for a, s in infer(model, t)] if has_letter(t) else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(SHARE))], names=["key", "languages"])

    return run


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: ``key``, ``languages`` (array of struct(lang, share), largest share first), ``lang_pred``
    and ``score``, the first of them.

    A NULL text, one without a letter, and every text under a model without languages is ``und`` with score 0 and no
    languages. NULL keys and repeated rows pass like others, an empty table gives no rows, other columns are not read.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(_predictor(model), f"key {kind}, languages array<struct<lang: string, share: double>>")
    first = F.get("languages", F.lit(0))
    return found.select(
        F.col("key").alias(key),
        "languages",
        F.coalesce(first["lang"], F.lit(UNKNOWN)).alias("lang_pred"),
        F.coalesce(first["share"], F.lit(0.0)).alias("score"),
    )


def held_out(key: Column) -> Column:
    """One document in four, by the CRC-32 of its key as text; a NULL key isn't held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
