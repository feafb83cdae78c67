"""Near-duplicates by SimHash and multi-index hashing.

Fingerprints are cut into segments of 32 bits. Two of them that differ in at most r bits differ little in some segment,
so each enumerates the small Hamming ball around its segment, fetches the table's fingerprints with these values, and the
complete distances are verified. Only distinct fingerprints take part; copies count once.

A segment value that many fingerprints share would make all their pairs candidates. Such crowded values, and the probes
that hit them, are looked up by the whole fingerprint instead: each enumerates the ball of radius 1 around itself, and two
of distance 2 or less meet at a common centre. At most 65 distinct fingerprints share a centre, all of them linked, and
one link from each to the least keeps them together. No pair is lost and the work stays linear.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import rows_of, text_print, whole
from chatloom.llm.components import components
from chatloom.session import stage

SEED, SHINGLE, RADIUS = 42, 3, 2
CROWDED = 16  # fingerprints that share a segment's value
CHUNK = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``size`` words joined by spaces, in chunks; of all words if there are fewer."""
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    begin, end = starts[: len(words) - size + 1], ends[size - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(begin), CHUNK):
        pairs = zip(begin[at : at + CHUNK].tolist(), end[at : at + CHUNK].tolist())
        yield np.array([digest(joined[b:e], seed) for b, e in pairs], np.uint64)


def majority(chunks: Iterator[np.ndarray]) -> int:
    """Bit i is set if it is in over half of the hashes; 0 without any."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in chunks:
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def _mapper(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [majority(shingle_hashes(words_of(t), size)) for t in batch.column(1).to_pylist()]
            signed = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed], names=["key", "print"])

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, print): the 64-bit fingerprint of the shingles of each whole text, as a signed number."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_mapper(shingle), f"key {rows.schema['key'].dataType.simpleString()}, print bigint")


def _flip(value: Column, bits: int) -> Column:
    """The ball of radius 1, without its centre."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)))


def links(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links that connect all distinct ``print`` values within two bits of each other.

    Two segments of 32 bits: a pair is equal in the second, or differs in at most one bit of the first.
    """
    high, low = F.shiftrightunsigned("print", 32), F.col("print").bitwiseAND(F.lit(0xFFFFFFFF))
    segments = F.array(F.struct(F.lit(0).alias("segment"), high.alias("value")), F.struct(F.lit(1).alias("segment"), low.alias("value")))
    index = stage(prints.select("print", F.explode(segments).alias("s")).select("print", "s.*"), "index")
    many = stage(index.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded).drop("n"), "crowded")

    # a pair one bit apart in the first segment is found by the one whose bit is 0
    larger = F.filter(_flip(F.col("value"), 32), lambda v: v > F.col("value"))
    near = F.when(F.col("segment") == 0, F.concat(F.array("value"), larger)).otherwise(F.array("value"))
    probes = index.select("print", "segment", F.explode(near).alias("value"))
    table = index.join(many, ["segment", "value"], "left_anti").select("segment", "value", F.col("print").alias("other"))
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("other")))
    own = F.col("value") == F.when(F.col("segment") == 0, high).otherwise(low)
    direct = probes.join(table, ["segment", "value"]).filter((distance <= RADIUS) & (~own | (F.col("print") < F.col("other"))))

    whole_ = probes.join(many, ["segment", "value"], "left_semi").select("print").distinct()
    centres = whole_.select("print", F.explode(F.concat(F.array("print"), _flip(F.col("print"), 64))).alias("centre"))
    met = centres.groupBy("centre").agg(F.collect_set("print").alias("all")).filter(F.size("all") > 1)  # at most 65
    hung = met.select(F.array_min("all").alias("b"), F.explode("all").alias("a")).filter(F.col("a") != F.col("b"))
    return direct.select(F.col("print").alias("a"), F.col("other").alias("b")).unionByName(hung.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row for each input row: ``key``, ``fingerprint`` (16 hex digits), ``component_id``.

    Fingerprints link at two or fewer differing bits; ``component_id`` is the smallest key that can be reached over links,
    NULL keys only where there is no other. A NULL text has no words: its fingerprint is zero and links like any other.
    Repeated rows share their component. An empty table gives no rows; other columns are not read.
    """
    marked = stage(fingerprints(docs, key, text, shingle), "fingerprints")
    prints = stage(marked.groupBy("print").agg(F.min("key").alias("first")), "prints")
    roots = components(links(prints.select("print"))).select(F.col("node").alias("print"), "root")
    rooted = prints.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage(rooted.select("print", "root").join(named, "root").select("print", "component_id"), "components")
    return marked.join(named, "print").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all their columns, of which one of each component of ``near_duplicates`` stays.

    It is the row of the smallest key; a NULL key stays only where there is no other, and of rows that repeat the key the one
    whose text has the smallest hash. Texts of no words are in one component. An empty table stays empty.
    """
    own = F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("key"), text_print(f"`{text}`").alias("print"))
    found = near_duplicates(docs.select(own.alias("id"), F.col(f"`{text}`").alias("text")), "id", "text", shingle)
    stays = found.select(F.col("component_id.key").alias("_key"), F.col("component_id.print").alias("_print"))
    return rows_of(docs, stays, key, text)
