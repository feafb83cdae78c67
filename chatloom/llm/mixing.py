"""Mixing sources to target weights under a time-varying curriculum.

A source's target is its share of all words, stopped at ``most`` times its size; the excess goes to the other sources by
weight. Its documents, in a reproducible random order and repeated if need be, form a stream of words; the first
``target`` words of it are taken. When they are read is told by the source's weight schedule w(t), t from 0 to 1: the
words demanded until t are the integral of w, so a word at share u of the stream has the position t where that integral
reaches u. Documents are range-sorted by position.

Only DataFrame functions are used. The text is read once, for its size (and once more where rows with texts are wanted).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import count_words, positions, whole
from chatloom.session import stage

WEIGHTS = (5, 2, 1)
#: Weight over training time at equal distances, one list for each entry of WEIGHTS; only the shape counts, the area
#: under it is the target. Heavy sources are even, middle ones grow, light ones come early and fade.
SCHEDULES = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))
AFTER_WORD = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
BUCKET_ROWS = 1 << 10
MOST_BUCKET_BITS = 20


def _level(sources: DataFrame, goal: float, most: float) -> float:
    """Words for each unit of weight: the excess of sources that stop is reshared until none is above its stop.

    A source that stops at one level stops at every higher one, so the level is the whole state of a round.
    """
    level, stops = 0.0, F.lit(False)
    while True:
        row = sources.agg(
            F.sum(F.when(stops, F.col("source_size"))).alias("stopped"), F.sum(F.when(~stops, F.col("weight"))).alias("open")
        ).first()
        if not row["open"]:
            return math.inf
        new = (goal - most * (row["stopped"] or 0)) / row["open"]
        if new <= level:
            return level
        level = new
        stops = most * F.col("source_size") < F.lit(level) * F.col("weight")


def _when_read(u: Column, shape: str) -> Column:
    """The time at which the integral of the schedule (linear between equidistant knots) reaches share ``u``.

    Inside a piece the integral is w0 x + (w1 - w0) / 2h x^2; the root is written so that nothing cancels.
    """
    spec = F.col(shape)
    pieces = F.size(spec) - 1
    h = F.lit(1.0) / pieces
    areas = F.transform(F.sequence(F.lit(0), pieces - 1), lambda k: (F.get(spec, k) + F.get(spec, k + 1)) * h / 2)
    total = F.aggregate(areas, F.lit(0.0), lambda a, x: a + x)
    start = F.struct(F.lit(0.0).alias("t"), (u * total).alias("rest"), F.lit(False).alias("over"))

    def step(a: Column, k: Column) -> Column:
        w0, w1, area = F.get(spec, k), F.get(spec, k + 1), F.get(areas, k)
        root = w0 + F.sqrt(F.greatest(w0 * w0 + 2 * (w1 - w0) / h * a["rest"], F.lit(0.0)))
        x = F.coalesce(F.try_divide(2 * a["rest"], root), F.lit(0.0))
        here = ~a["over"] & (a["rest"] < area)
        return F.struct(
            F.when(a["over"], a["t"]).when(here, a["t"] + x).otherwise(a["t"] + h).alias("t"),
            F.when(a["over"] | here, a["rest"]).otherwise(a["rest"] - area).alias("rest"),
            (a["over"] | here).alias("over"),
        )

    return F.least(F.aggregate(F.sequence(F.lit(0), pieces - 1), start, step, lambda a: a["t"]), F.lit(1.0))


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    share: float = 1.5,
    most: float = 2.0,
    cut: bool = True,
    seed: int = 42,
) -> DataFrame:
    """One row for each document: key, source, ``size``, ``source_size``, ``weight``, ``target``, ``takes``, ``taken``.

    ``size`` counts words (NULL text: 0). Sources, by code point and NULL last, get ``weights`` in turn. ``takes`` lists
    what the mix takes of the document: struct(pass, words, position), one entry for each pass over the source that
    reaches it; ``taken`` is the sum of its words. With ``cut`` the document at the end of the stream gives its first
    words only, so that a source's words equal its target rounded; without, it is taken whole if at least half of it is
    due. Equal input rows are interchangeable; otherwise the result depends on the rows alone, not on their partitions.
    Documents without words take nothing. An empty table gives no rows; extra columns are not read.
    """
    hashed = F.xxhash64(whole(F.col(f"`{text}`")))
    sized = stage(
        docs.select(
            F.col(f"`{key}`").alias("_key"),
            F.col(f"`{source}`").cast("string").alias("_source"),
            count_words(F.col(f"`{text}`")).alias("size"),
            hashed.alias("_text"),
            F.xxhash64(F.lit(seed), F.col(f"`{key}`"), hashed).alias("_order"),
            F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("")).alias("_s"),
        ),
        "sizes",
    )
    totals = sized.groupBy("_s").agg(F.sum("size").alias("source_size"), F.first("_source").alias("_name"))
    ranked = positions(totals, [F.col("_name").isNull(), F.col("_name")], "_rank", "sources")
    turn = (F.col("_rank") % len(weights)).cast("int")
    shapes = F.array(*[F.array(*[F.lit(float(w)) for w in s]) for s in schedules])
    sources = stage(
        ranked.select(
            "_s",
            "source_size",
            F.get(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"),
            F.get(shapes, turn % len(schedules)).alias("_shape"),
        ),
        "weights",
    )
    row = sources.agg(F.sum("source_size").alias("words")).first()
    goal = share * (row["words"] or 0)
    level = _level(sources, goal, most)
    sources = sources.withColumn("target", F.least(most * F.col("source_size"), F.lit(level) * F.col("weight")))
    sources = sources.withColumn("_due", F.rint("target").cast("bigint"))

    bits = min(MOST_BUCKET_BITS, max(0, (sized.count() // BUCKET_ROWS).bit_length()))
    bucket = F.shiftrightunsigned(F.col("_order"), 64 - bits) if bits else F.lit(0).cast("bigint")
    sized = sized.withColumn("_bucket", bucket)
    sums = sized.groupBy("_s", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_s", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")).join(sources, "_s")
    within = Window.partitionBy("_s", "_bucket").orderBy("_order", "_key", "_text").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["_s", "_bucket"])
    at = F.col("_offset") + F.col("_inside")

    takes = []
    for p in range(math.ceil(most)):
        begin = at + p * F.col("source_size")
        due = F.least(F.greatest(F.col("_due") - begin, F.lit(0)), F.col("size"))
        words = due if cut else F.when(due * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
        when = _when_read(F.try_divide(begin, F.col("_due")), "_shape")
        takes.append(F.struct(F.lit(p).alias("pass"), words.cast("bigint").alias("words"), when.alias("position")))
    return placed.select(
        F.col("_key").alias(key),
        F.col("_source").alias(source),
        "_text",
        "size",
        "source_size",
        "weight",
        "target",
        F.filter(F.array(*takes), lambda t: t["words"] > 0).alias("takes"),
    ).withColumn("taken", F.aggregate("takes", F.lit(0).cast("bigint"), lambda a, t: a + t["words"]))


def first_position() -> Column:
    """Where a document is read first; NULL if it isn't taken."""
    return F.array_min(F.transform("takes", lambda t: t["position"]))


def training_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``docs`` (all their columns), one for each take, range-sorted by position.

    A take of fewer words than the document has ends its text after that many words. Rows are found again by key, text
    and source; rows that repeat all three are matched with their takes one to one.
    """
    plan = mix_sources(docs, key, text, source, **options)
    identity = [
        F.coalesce(F.concat(F.lit("="), F.col(f"`{key}`").cast("string")), F.lit("")).alias("_k"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("")).alias("_s"),
    ]
    hashed = F.xxhash64(whole(F.col(f"`{text}`")))
    same = Window.partitionBy("_k", "_s", "_h").orderBy(F.lit(0))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"), *identity, hashed.alias("_h"))
    rows = rows.withColumn("_nth", F.row_number().over(same))
    taken = plan.select(*identity, F.col("_text").alias("_h"), F.struct("size", "takes").alias("_own"))
    taken = taken.groupBy("_k", "_s", "_h").agg(F.collect_list("_own").alias("_all"))
    rows = rows.join(taken, ["_k", "_s", "_h"]).select("_in", F.get("_all", F.col("_nth") - 1).alias("_own"))
    rows = rows.select("_in", "_own.size", F.explode("_own.takes").alias("_take"))
    body, words = F.col("_in").getField(text), F.col("_take.words")
    first_words = F.concat_ws("", F.slice(F.split(body, AFTER_WORD), F.lit(1), words.cast("int")))
    due = F.when(words == F.col("size"), body).otherwise(first_words)
    ordered = rows.orderBy("_take.position", "_take.pass")
    return ordered.select(*[(due if c == text else F.col("_in").getField(c)).alias(c) for c in docs.columns])
