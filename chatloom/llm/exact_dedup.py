"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. One narrow pass writes (key, 64-bit fingerprint, SHA-256, input partition) of every row to the shared folder.
2. Every partition sends its distinct fingerprints, sorted and Golomb-coded, to the owners of the fingerprint ranges, with
   one bit for each: whether it is repeated in the partition. However often a text occurs, its owner gets one for each
   partition.
3. Owners answer each partition with a bitmap: which of its fingerprints occur more than once anywhere.
4. Partitions mark their suspects. Only suspects' texts are compared byte by byte; copies combine before that shuffle,
   so a text that fills a third of the table is one row for each task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm import golomb
from chatloom.llm.common import whole
from chatloom.session import stage

OWNER_ROWS = 1 << 14  # fingerprints that an owner gets, about
MOST_OWNER_BITS = 14


def _owner_bits(rows: int) -> int:
    return min(MOST_OWNER_BITS, max(0, (rows // OWNER_ROWS).bit_length()))


def _cuts(values: np.ndarray, bits: int) -> np.ndarray:
    """Where the owners' shares begin in the sorted values, and their end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(values, edges, "left"), [len(values)]])


def _prints(table: pa.Table) -> np.ndarray:
    return table["_print"].to_numpy().astype(np.int64).view(np.uint64)


def _sender(bits: int) -> Callable:
    def send(table: pa.Table) -> pa.Table:
        values, counts = np.unique(_prints(table), return_counts=True)
        cuts = _cuts(values, bits)
        rows = []
        for owner in np.flatnonzero(np.diff(cuts)):
            share = values[cuts[owner] : cuts[owner + 1]]
            again = np.packbits(counts[cuts[owner] : cuts[owner + 1]] > 1).tobytes()
            shift, high, low = golomb.encode(share, int(owner) << (64 - bits), 64 - bits)
            rows.append({"owner": int(owner), "_part": table["_part"][0].as_py(), "n": len(share), "shift": shift, "high": high, "low": low, "again": again})
        return pa.Table.from_pylist(rows, SENT)

    return send


SENT = pa.schema([("owner", pa.int32()), ("_part", pa.int32()), ("n", pa.int32()), ("shift", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("again", pa.binary())])
SENT_SQL = "owner int, _part int, n int, shift int, high binary, low binary, again binary"
ANSWER = pa.schema([("_part", pa.int32()), ("owner", pa.int32()), ("bitmap", pa.binary())])
ANSWER_SQL = "_part int, owner int, bitmap binary"


def _answerer(bits: int) -> Callable:
    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        start = rows[0]["owner"] << (64 - bits)
        shares = [golomb.decode(r["n"], r["shift"], r["high"], r["low"], start) for r in rows]
        _, which, counts = np.unique(np.concatenate(shares), return_inverse=True, return_counts=True)
        again = np.concatenate([np.unpackbits(np.frombuffer(r["again"], np.uint8), count=r["n"]) for r in rows])
        repeated = ((counts > 1) | (np.bincount(which, again) > 0))[which]
        ends = np.cumsum([r["n"] for r in rows])
        found = [
            {"_part": r["_part"], "owner": r["owner"], "bitmap": np.packbits(repeated[end - r["n"] : end]).tobytes()}
            for r, end in zip(rows, ends)
        ]
        return pa.Table.from_pylist(found, ANSWER)

    return answer


def _marker(bits: int) -> Callable:
    def mark(own: pa.Table, answers: pa.Table) -> pa.Table:
        values, which = np.unique(_prints(own), return_inverse=True)
        cuts = _cuts(values, bits)
        marked = np.zeros(len(values), bool)
        for a in answers.to_pylist():
            begin, end = cuts[a["owner"]], cuts[a["owner"] + 1]
            marked[begin:end] = np.unpackbits(np.frombuffer(a["bitmap"], np.uint8))[: end - begin].astype(bool)
        return own.filter(pa.array(marked[which])).drop_columns(["_part"])

    return mark


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each input row: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``text_print``
    (the XXH64 of the text, by which rows are found again).

    Of rows with equal (normalised) texts the one with the largest key stays. A NULL text counts as empty. A NULL key
    is smaller than any other and stays only if all keys of its group are NULL. Rows that repeat both key and text are
    copies like others: exactly one of them has ``kept``. An empty table gives an empty result; other columns are
    not read, whatever their names.
    """
    body = (normalise or (lambda c: c))(whole(F.col(f"`{text}`")))
    texts = docs.select(F.col(f"`{key}`").alias("_key"), body.alias("_text"))
    prints = stage(
        texts.select(
            "_key",
            F.xxhash64("_text").alias("_print"),
            F.sha2("_text", 256).alias("_sha"),
            F.monotonically_increasing_id().alias("_row"),
            F.spark_partition_id().alias("_part"),
        ),
        "prints",
    )
    bits = _owner_bits(prints.count())
    narrow = prints.select("_part", "_print")
    sent = narrow.groupBy("_part").applyInArrow(_sender(bits), SENT_SQL)
    answers = sent.groupBy("owner").applyInArrow(_answerer(bits), ANSWER_SQL)
    suspect_columns = ["_key", "_print", "_sha", "_row"]
    kinds = ", ".join(f"{c} {prints.schema[c].dataType.simpleString()}" for c in suspect_columns)
    suspects = stage(
        prints.select(*suspect_columns, "_part").groupBy("_part").cogroup(answers.groupBy("_part")).applyInArrow(_marker(bits), kinds),
        "suspects",
    )
    # rows are found again by key and fingerprint: even however hot a text is, and harmless for repeated rows
    wanted = suspects.select(F.col("_key").alias("_k"), F.col("_print").alias("_p")).distinct().hint("merge")  # one plan at every size
    same_bytes = (
        texts.withColumn("_print", F.xxhash64("_text"))
        .join(wanted, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_print") == F.col("_p")), "left_semi")
        .groupBy("_print", "_text")
        .agg(F.count(F.lit(1)).alias("group_size"))
        .select("_print", F.sha2("_text", 256).alias("_sha"), "group_size")
        .filter("group_size > 1")
    )
    stays = suspects.groupBy("_print", "_sha").agg(F.max(F.struct("_key", "_row")).alias("_stay"))
    groups = stage(same_bytes.join(stays, ["_print", "_sha"]), "groups")
    alone = F.col("_stay").isNull()
    return prints.join(groups, ["_print", "_sha"], "left").select(
        F.col("_key").alias(key),
        F.when(alone, F.col("_key")).otherwise(F.col("_stay._key")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("_row") == F.col("_stay._row"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        F.col("_print").alias("text_print"),
    )
