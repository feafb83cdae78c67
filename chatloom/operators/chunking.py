"""Long documents to bounded chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom import fixed_values as fv
from chatloom.functions.chat import count_tokens, tokenize
from chatloom.functions.text import strip
from chatloom.operators.once import compute_once

PAD_TOKEN = "[PAD]"


def split_sentences(text: Column) -> Column:
    """Sentences end at ``.``, ``!`` or ``?`` before a blank."""
    return F.filter(F.split(strip(text), r"(?<=[.!?])\s+", -1), lambda s: s != "")


def pack_sentences(lengths: Column, window: int) -> Column:
    """Greedy packing: array of ``struct<first, n, tokens>``, one per chunk, from the sentences' token counts.

    A sentence opens a new chunk when the current one would exceed the window; sentences are never cut, so a chunk
    may exceed the window, and an oversized first sentence leaves chunk 0 empty. Each step only touches the open
    chunk; the list of finished chunks grows once per chunk.
    """
    def chunk(first: Column, n: Column, tokens: Column) -> Column:
        return F.struct(first.cast("int").alias("first"), n.cast("int").alias("n"), tokens.cast("int").alias("tokens"))

    zero = F.lit(0)
    start = F.struct(
        F.array().cast("array<struct<first:int,n:int,tokens:int>>").alias("done"), chunk(zero, zero, zero).alias("open")
    )

    def step(state: Column, size: Column) -> Column:
        open_ = state["open"]
        full = open_["tokens"] + size > window
        return F.struct(
            F.when(full, F.array_append(state["done"], open_)).otherwise(state["done"]).alias("done"),
            F.when(full, chunk(open_["first"] + open_["n"], F.lit(1), size))
            .otherwise(chunk(open_["first"], open_["n"] + 1, open_["tokens"] + size))
            .alias("open"),
        )

    return F.aggregate(lengths, start, step, lambda s: F.array_append(s["done"], s["open"]))


def chunk_documents(
    df: DataFrame, text: str, window: int = fv.DOCUMENT_WINDOW, out: str = "chunks", split: Callable[[Column], Column] = split_sentences
) -> DataFrame:
    """Add ``chunks``: ``array<struct<tokens, sentences, text>>``. An empty text gives one empty chunk.

    ``split`` cuts a text into sentences: at every end mark before a blank, or as learned (``sentence_splitter``).
    """
    cut = compute_once(df, _sentences=split(F.col(text)))
    packed = cut.withColumn("_packed", pack_sentences(F.transform("_sentences", count_tokens), window))
    chunks = F.transform(
        "_packed",
        lambda c: F.struct(
            c["tokens"].cast("bigint").alias("tokens"),
            c["n"].cast("bigint").alias("sentences"),
            F.array_join(F.slice(F.col("_sentences"), c["first"] + 1, c["n"]), " ").alias("text"),
        ),
    )
    return compute_once(packed, **{out: chunks}).drop("_sentences", "_packed")


def chunk_texts(chunks: Column) -> Column:
    return F.transform(chunks, lambda c: c["text"])


def cap_chunks(df: DataFrame, max_chunks: int, chunks: str = "chunks") -> DataFrame:
    """Drop rows with more chunks than allowed."""
    return df.filter(F.size(chunks) <= max_chunks)


def clip_documents(df: DataFrame, documents: str, window: int = fv.DOCUMENT_WINDOW, out: str = "clipped") -> DataFrame:
    """Add ``array<struct<tokens, mask>>``: the documents' tokens cut to the window and padded to the row's longest."""
    cut = compute_once(df, _cut=F.transform(documents, lambda d: F.slice(tokenize(d), 1, window)))
    longest = compute_once(cut, _longest=F.aggregate("_cut", F.lit(0), lambda acc, t: F.greatest(acc, F.size(t))))
    padded = F.transform(
        "_cut",
        lambda t: F.struct(
            F.concat(t, F.array_repeat(F.lit(PAD_TOKEN), F.col("_longest") - F.size(t))).alias("tokens"),
            F.concat(
                F.array_repeat(F.lit(1), F.size(t)), F.array_repeat(F.lit(0), F.col("_longest") - F.size(t))
            ).alias("mask"),
        ),
    )
    return compute_once(longest, **{out: padded}).drop("_cut", "_longest")
