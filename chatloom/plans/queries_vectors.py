"""Queries over spans, vector lookup, scatter, pooling, projection, loss and geometry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.functions import hashing, media, vectors
from chatloom.operators import blocks, embedding, encoding, hooks, turns
from chatloom.operators.embedding import Projector
from chatloom.plans import standins
from chatloom.plans.queries_encode import SPECS, encodable, sql_ids
from chatloom.plans.registry import query, sql_hash
from chatloom.registry import ModalitySpec
from chatloom.session import stage

BATCH = 8


def sql_checksum(vector: str) -> str:
    return f"list_sum(list_transform({vector}, lambda v, i: floor(v::DOUBLE * 1e6 + 0.5)::BIGINT * i))::BIGINT"


# ---- spans and vectors in the sequence -------------------------------------------------------------------------

SQL_SPANS = """spots AS (SELECT conv_id, pos, id, pos - row_number() OVER (PARTITION BY conv_id, id ORDER BY pos) AS island FROM ids WHERE id < 0),
runs AS (SELECT conv_id, id, island, min(pos) AS first, count(*) AS run, CASE WHEN id = -1626 THEN 10 ELSE 4 END AS width FROM spots GROUP BY ALL),
starts AS (SELECT conv_id, id, width, first + j * width AS start FROM runs, LATERAL (SELECT unnest(range(run // width)) AS j)),
spans AS (SELECT conv_id, CASE WHEN id = -1626 THEN 'vision_clip' ELSE 'document_gte' END AS name,
    row_number() OVER (PARTITION BY conv_id, id ORDER BY start) - 1 AS k, start, width FROM starts)"""


def _spans(spark: SparkSession, sf: str, ready: DataFrame | None = None) -> DataFrame:
    """Spans of all chats that can be encoded, from sequences in one piece per turn; no word is looked up."""
    ready = encodable(spark, sf) if ready is None else ready
    sequences = stage(turns.code_sequences(ready, "conv_id", "turn", SPECS), "sequences")
    return turns.turn_spans(sequences, "conv_id", "turn", SPECS)


_SPANS_SQL = f"WITH {sql_ids()}, {SQL_SPANS} SELECT conv_id, name, k, start::BIGINT AS start, width::BIGINT AS width FROM spans"


@query("find_spans", _SPANS_SQL)
def find_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Over whole sequences, one row per chat."""
    return embedding.find_spans(encoding.encode_chat(standins.chats(spark, sf), "conv_id", SPECS), "conv_id", SPECS)


@query("turn_spans", _SPANS_SQL)
def turn_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The same spans from sequences in one piece per turn."""
    return _spans(spark, sf)


@query(
    "embed_tokens",
    f"""WITH {sql_ids()}, n AS (SELECT count(*) AS n FROM embeddings)
SELECT i.conv_id, i.pos, i.id::BIGINT AS token_id, e.vec_id, {sql_checksum('e.embedding')} AS vec_check
FROM ids i CROSS JOIN n LEFT JOIN embeddings e ON i.id >= 0 AND e.vec_id = i.id % n.n""",
)
def embed_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Every position with the checksum of its vector; placeholder positions have none yet."""
    tokens = stage(turns.positions(encodable(spark, sf), "conv_id", "turn", SPECS), "tokens")
    vocab = encoding.build_vocab(tokens)
    ids = encoding.attach_ids(tokens, vocab).select("conv_id", "pos", "token_id")
    table = standins.table(spark, sf, "embeddings")
    entries = standins.token_vectors(vocab, table, table.count())
    checked = stage(entries.withColumn("vec_check", vectors.checksum(F.col("embedding"))).drop("embedding"), "token_vectors")
    return embedding.embed_tokens(ids, checked).select("conv_id", "pos", "token_id", "vec_id", "vec_check")


_ITEMS = """items AS (SELECT conv_id, 'vision_clip' AS name, unnest(range(conv_id % 4 - CASE WHEN conv_id % 10 = 6 AND conv_id % 4 > 0 THEN 1 ELSE 0 END
    + CASE WHEN conv_id % 10 = 7 THEN 1 ELSE 0 END)) AS k FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, 'document_gte', 0 FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 = 0)"""


def _slots(spark: SparkSession, sf: str, n: int) -> DataFrame:
    """``(conv_id, name, k, slot, vec_id)``: the row of the embeddings table in each slot of each item."""
    chats = standins.chats(spark, sf)
    items = None
    for spec in SPECS:
        listed = chats.select("conv_id", F.lit(spec.name).alias("name"), F.posexplode_outer(spec.data_key).alias("k", "item"))
        part = listed.filter(F.col("k").isNotNull()).select(
            "conv_id", "name", F.col("k").cast("bigint").alias("k"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spec.width - 1).cast("bigint"))).alias("slot"),
        )
        items = part if items is None else items.unionByName(part)
    key = hashing.key_text(F.col("conv_id"), F.col("name"), F.col("k"))
    return items.withColumn("vec_id", (hashing.hash32(key, "item") + F.col("slot")) % n)


@query(
    "scatter_items",
    f"""WITH {sql_ids()}, {SQL_SPANS}, {_ITEMS}, n AS (SELECT count(*) AS n FROM embeddings),
slots AS (SELECT i.conv_id, i.name, i.k, s.slot, ({sql_hash("i.conv_id || ':' || i.name || ':' || i.k", 'item')} + s.slot) % n.n AS vec_id
  FROM items i, n, LATERAL (SELECT unnest(range(CASE WHEN i.name = 'vision_clip' THEN 10 ELSE 4 END)) AS slot) s),
places AS (SELECT conv_id, name, k, start + s.slot AS pos, s.slot FROM spans, LATERAL (SELECT unnest(range(width)) AS slot) s)
SELECT p.conv_id, p.name, p.k, p.slot, p.pos::BIGINT AS pos, t.vec_id, {sql_checksum('e.embedding')} AS vec_check,
  CASE WHEN t.vec_id IS NULL THEN 'missing item' ELSE 'filled' END AS status
FROM places p LEFT JOIN slots t USING (conv_id, name, k, slot) LEFT JOIN embeddings e ON e.vec_id = t.vec_id""",
)
def scatter_items(spark: SparkSession, sf: str) -> DataFrame:
    """Item vectors into their spans. The vector of a slot is a row of the embeddings table, found by its number."""
    table = standins.table(spark, sf, "embeddings").select("vec_id", vectors.checksum(F.col("embedding")).alias("vec_check"))
    slots = _slots(spark, sf, table.count()).join(table, "vec_id")
    spans = _spans(spark, sf)
    filled = embedding.scatter_items(spans, slots, "conv_id")
    return filled.select("conv_id", "name", "k", "slot", "pos", "vec_id", "vec_check", "status")


def _linear(size: int) -> Projector:
    """One layer from a rule."""
    grid = np.arange(size * size, dtype=np.float64).reshape(size, size)
    return Projector((((np.sin(grid * 0.7) / np.sqrt(size), np.sin(np.arange(size) * 0.7 + 0.1)),),))


@query(
    "input_vectors",
    f"""WITH {sql_ids()}, {SQL_SPANS}, {_ITEMS}, n AS (SELECT count(*) AS n FROM embeddings),
x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT vec_id, j, sum(x * sin((i * 64 + j) * 0.7::DOUBLE) / 8) + sin(j * 0.7::DOUBLE + 0.1::DOUBLE) AS v FROM x, (SELECT unnest(range(64)) AS j) GROUP BY vec_id, j),
projected AS (SELECT vec_id, round(sum(abs(v)), 6) AS size FROM p GROUP BY vec_id),
slots AS (SELECT i.conv_id, i.name, i.k, s.slot, ({sql_hash("i.conv_id || ':' || i.name || ':' || i.k", 'item')} + s.slot) % n.n AS vec_id
  FROM items i, n, LATERAL (SELECT unnest(range(CASE WHEN i.name = 'vision_clip' THEN 10 ELSE 4 END)) AS slot) s),
places AS (SELECT conv_id, name, k, start + s.slot AS pos, s.slot FROM spans, LATERAL (SELECT unnest(range(width)) AS slot) s),
filled AS (SELECT p.conv_id, p.pos, r.size FROM places p JOIN slots t USING (conv_id, name, k, slot) JOIN projected r USING (vec_id)),
plain AS (SELECT vec_id, round(sum(abs(x)), 6) AS size FROM x GROUP BY vec_id)
SELECT i.conv_id, i.pos, CASE WHEN i.id >= 0 THEN 'text' WHEN f.size IS NOT NULL THEN 'item' ELSE 'zero' END AS kind,
  CASE WHEN i.id >= 0 THEN e.size ELSE coalesce(f.size, 0) END AS size
FROM ids i CROSS JOIN n LEFT JOIN plain e ON e.vec_id = i.id % n.n LEFT JOIN filled f ON f.conv_id = i.conv_id AND f.pos = i.pos""",
)
def input_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The whole sequences of vectors: text, projected items, zeros. ``size`` is the sum of absolute values.

    Positions carry references throughout; vectors lie where the tasks that read or projected them wrote them.
    """
    ready = encodable(spark, sf)
    found = stage(turns.positions(ready, "conv_id", "turn", SPECS), "positions")
    vocab = encoding.build_vocab(found)
    ids = encoding.attach_ids(found, vocab).select("conv_id", "pos", "token_id")
    table = standins.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    plain = blocks.store_vectors(table, ["vec_id"], "embedding", 64, "double")
    projected = embedding.project_vectors(table, "vec_id", "embedding", _linear(64))
    items = blocks.store_vectors(projected, ["vec_id"], "projected", 64, "double", beside=plain)
    n = plain.index.count()
    embedded = embedding.embed_tokens(ids, stage(standins.token_vectors(vocab, plain.index, n).drop("vec_id"), "token_references"))
    filled = embedding.scatter_items(_spans(spark, sf, ready), _slots(spark, sf, n).join(items.index, "vec_id"), "conv_id")
    rows = embedding.input_vectors(embedded, filled, "conv_id", plain)
    size = F.aggregate("vector", F.lit(0.0), lambda a, v: a + F.abs(v))
    return rows.select("conv_id", "pos", "kind", F.round(size, 6).alias("size"))


@query(
    "surplus_items",
    f"""WITH {sql_ids()}, {SQL_SPANS}, {_ITEMS}
SELECT conv_id, name, k::BIGINT AS k FROM items ANTI JOIN spans USING (conv_id, name, k)""",
)
def surplus_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items that no span asks for, those of chats that cannot be encoded included."""
    chats = standins.chats(spark, sf)
    spans = _spans(spark, sf)
    items = None
    for spec in SPECS:
        listed = chats.select("conv_id", F.lit(spec.name).alias("name"), F.posexplode_outer(spec.data_key).alias("k", "item"))
        part = listed.filter(F.col("k").isNotNull()).select("conv_id", "name", F.col("k").cast("bigint").alias("k"))
        items = part if items is None else items.unionByName(part)
    return embedding.surplus_items(spans, items, "conv_id")


# ---- pooling, samples, projection ------------------------------------------------------------------------------------


@query(
    "masked_mean_pool",
    """WITH f AS (SELECT label, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS m, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT label::BIGINT AS label, dim::BIGINT AS dim, round(sum(m * v) / sum(m), 5) AS mean FROM f GROUP BY label, dim""",
)
def masked_mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    table = standins.table(spark, sf, "embeddings").withColumn("mask", F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1))
    pooled = embedding.masked_mean_pool(table, "label", "embedding", "mask")
    flat = pooled.select(F.col("label").cast("bigint").alias("label"), F.posexplode("embedding").alias("dim", "mean"))
    return flat.select("label", F.col("dim").cast("bigint").alias("dim"), F.round("mean", 5).alias("mean"))


@query(
    "to_mono",
    f"""WITH m AS (SELECT vec_id, list_transform(range(len(embedding) // 2), lambda i: (embedding[2 * i + 1]::DOUBLE + embedding[2 * i + 2]::DOUBLE) / 2.0::DOUBLE) AS mono FROM embeddings)
SELECT vec_id, len(mono)::BIGINT AS samples, round(mono[1], 6) AS first_sample, {sql_checksum('mono')} AS samples_check FROM m""",
)
def to_mono(spark: SparkSession, sf: str) -> DataFrame:
    frames = vectors.as_frames(F.col("embedding"), 2)
    mono = standins.table(spark, sf, "embeddings").select("vec_id", vectors.to_mono(frames).alias("mono"))
    return mono.select(
        "vec_id",
        F.size("mono").cast("bigint").alias("samples"),
        F.round(F.element_at("mono", 1), 6).alias("first_sample"),
        vectors.checksum(F.col("mono")).alias("samples_check"),
    )


def fixed_projector(slots: int, size: int, hidden: int) -> Projector:
    """Small two-layer weights from a rule, the same on every run."""

    def wave(rows: int, cols: int, phase: float) -> np.ndarray:
        grid = np.arange(rows * cols, dtype=np.float64).reshape(rows, cols)
        return np.sin(grid * 0.7 + phase) / np.sqrt(rows)

    return Projector(
        tuple(
            ((wave(size, hidden, s), wave(1, hidden, s + 0.1)[0]), (wave(hidden, hidden, s + 0.2), wave(1, hidden, s + 0.3)[0]))
            for s in range(slots)
        )
    )


def sql_wave(row: str, column: str, columns: int, phase: str, rows: int) -> str:
    return f"sin(({row} * {columns} + {column}) * 0.7::DOUBLE + {phase}) / sqrt({rows}::DOUBLE)"


@query(
    "project_vectors",
    f"""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
slots AS (SELECT unnest(range(4)) AS slot), units AS (SELECT unnest(range(16)) AS j),
h AS (SELECT vec_id, slot, j, sum(x * {sql_wave('i', 'j', 16, 'slot', 64)}) + {sql_wave('0', 'j', 16, '(slot + 0.1::DOUBLE)', 1)} AS h FROM x, slots, units GROUP BY vec_id, slot, j),
c AS (SELECT n, exp(2 * n * ln(2::DOUBLE) + lgamma(n + 1) - lgamma(2 * n + 2)) AS c FROM range(120) r(n)),
e AS (SELECT vec_id, slot, j, h, 2 / sqrt(pi()) * exp(-h * h / 2) * sum(c * (h / sqrt(2::DOUBLE)) ** (2 * n + 1)) AS erf FROM h, c GROUP BY vec_id, slot, j, h),
g AS (SELECT vec_id, slot, j, h * 0.5::DOUBLE * (1 + erf) AS g FROM e)
SELECT vec_id, slot, k AS dim, round(sum(g * {sql_wave('j', 'k', 16, '(slot + 0.2::DOUBLE)', 16)}) + {sql_wave('0', 'k', 16, '(slot + 0.3::DOUBLE)', 1)}, 6) AS value
FROM g, (SELECT unnest(range(16)) AS k) GROUP BY vec_id, slot, k""",
)
def project_vectors(spark: SparkSession, sf: str) -> DataFrame:
    table = standins.table(spark, sf, "embeddings").select("vec_id", "embedding")
    projected = embedding.project_vectors(table, "vec_id", "embedding", fixed_projector(4, 64, 16))
    flat = projected.select("vec_id", "slot", F.posexplode("projected").alias("dim", "value"))
    return flat.select("vec_id", "slot", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


def _lengths(texts: list) -> list:
    """An ``encode`` hook: a text's characters, blanks and a one."""
    return [[float(len(t)), float(t.count(" ")), 1.0] for t in texts]


def _joined(lists: list) -> list:
    """A ``preprocess`` hook: the items of a list, joined; it refuses lists that hold an empty one."""
    if any(not t for items in lists for t in items):
        raise ValueError("empty item")
    return [" | ".join(items) for items in lists]


_HOOKED = ModalitySpec("joined", "<joined>", "texts", 3, preprocess=_joined, encode=_lengths)
_SQL_TEXTS = """t AS (SELECT conv_id, CASE WHEN conv_id % 11 <> 0 THEN list(CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN '' ELSE coalesce(text, '-') END ORDER BY turn) END AS texts
  FROM conversations GROUP BY conv_id)"""


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """``conv_id, texts``: the turns of each chat as its items; some lists are missing, some hold an empty item."""
    turn = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 1), "").otherwise(F.coalesce("text", F.lit("-")))
    rows = standins.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("r"))
    return rows.select("conv_id", F.when(F.col("conv_id") % 11 != 0, F.transform("r", lambda r: r["t"])).alias("texts"))


@query(
    "preprocess_hook",
    f"""WITH {_SQL_TEXTS}, e AS (SELECT *, list_contains(texts, '') AS bad FROM t)
SELECT conv_id, CASE WHEN NOT bad THEN array_to_string(texts, ' | ') END AS value,
  CASE WHEN texts IS NULL THEN 'no texts' WHEN bad THEN 'ValueError: empty item' END AS error FROM e""",
)
def preprocess_hook(spark: SparkSession, sf: str) -> DataFrame:
    return hooks.preprocess_rows(_texts(spark, sf), "conv_id", _HOOKED, T.StringType())


@query(
    "encode_hook",
    f"""WITH {_SQL_TEXTS}, i AS (SELECT conv_id, unnest(texts) AS x, generate_subscripts(texts, 1) - 1 AS k FROM t)
SELECT conv_id, 'joined' AS name, k::BIGINT AS k, length(x)::DOUBLE AS characters, (length(x) - length(replace(x, ' ', '')))::DOUBLE AS blanks FROM i""",
)
def encode_hook(spark: SparkSession, sf: str) -> DataFrame:
    items = _texts(spark, sf).select("conv_id", F.posexplode("texts").alias("k", "value"))
    found = hooks.encode_items(items, "conv_id", _HOOKED)
    return found.select("conv_id", "name", "k", F.get("vector", F.lit(0)).cast("double").alias("characters"), F.get("vector", F.lit(1)).cast("double").alias("blanks"))


# ---- loss --------------------------------------------------------------------------------------------------------------


@query(
    "supervised_loss",
    f"""WITH {sql_ids()}, l AS (SELECT conv_id, pos, lead(CASE WHEN masked THEN -100 ELSE id END) OVER (PARTITION BY conv_id ORDER BY pos) AS next FROM ids)
SELECT conv_id // {BATCH} AS batch_id, round(avg(({sql_hash("conv_id || ':' || pos", 'nll')} % 8192) / 1024.0::DOUBLE), 9) AS loss, count(*) AS positions
FROM l WHERE next IS NOT NULL AND next <> -100 GROUP BY batch_id""",
)
def supervised_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Mean loss per batch of chats. The per-position losses are a table made by rule for every position."""
    found = turns.positions(encodable(spark, sf), "conv_id", "turn", SPECS)
    nll = found.select(
        "conv_id",
        "pos",
        (hashing.pick_index(hashing.key_text(F.col("conv_id"), F.col("pos")), "nll", 8192) / F.lit(1024.0)).alias("nll"),
    )
    batched = found.withColumn("batch_id", F.floor(F.col("conv_id") / BATCH).cast("bigint"))
    return embedding.supervised_loss(batched, "conv_id", nll, ["batch_id"]).select(
        "batch_id", F.round("loss", 9).alias("loss"), "positions"
    )


# ---- geometry ------------------------------------------------------------------------------------------------------------


@query(
    "square_pad_box",
    """SELECT p_partkey, greatest(p_size, length(p_name))::BIGINT AS side,
  ((greatest(p_size, length(p_name)) - p_size) // 2)::BIGINT AS x, ((greatest(p_size, length(p_name)) - length(p_name)) // 2)::BIGINT AS y FROM part""",
)
def square_pad_box(spark: SparkSession, sf: str) -> DataFrame:
    box = media.square_pad_box(F.col("p_size"), F.length("p_name"))
    return standins.table(spark, sf, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.side", "b.x", "b.y")


def sql_frames(key: str, frames: str) -> str:
    e = f"(8 + {sql_hash(key, 'frames')} % greatest({frames} - 8, 1))"
    return f"floor(least({e} - 1, {e} - 8 + 8.0::DOUBLE * i / 7))::BIGINT"


@query(
    "frame_indices",
    f"""WITH s AS (SELECT 'part' AS origin, p_partkey::VARCHAR AS key, p_size::BIGINT AS frames FROM part
  UNION ALL SELECT 'lineitem', l_orderkey || '-' || l_linenumber, l_quantity::BIGINT FROM lineitem)
SELECT origin, key, frames, CASE WHEN frames > 8 THEN (SELECT string_agg({sql_frames('key', 'frames')}::VARCHAR, ' ' ORDER BY i) FROM range(8) r(i)) END AS indices FROM s""",
)
def frame_indices(spark: SparkSession, sf: str) -> DataFrame:
    parts = standins.table(spark, sf, "part").select(
        F.lit("part").alias("origin"), F.col("p_partkey").cast("string").alias("key"), F.col("p_size").cast("bigint").alias("frames")
    )
    lines = standins.table(spark, sf, "lineitem").select(
        F.lit("lineitem").alias("origin"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"),
        F.col("l_quantity").cast("bigint").alias("frames"),
    )
    chosen = media.frame_indices(F.col("key"), 8, 1, F.col("frames"))
    return parts.unionByName(lines).select(
        "origin", "key", "frames", F.array_join(F.transform(chosen, lambda x: x.cast("string")), " ").alias("indices")
    )
