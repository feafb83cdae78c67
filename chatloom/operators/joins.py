"""Lookups by row number, path or token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_BYTES = 256 << 20
# keys that make up more than 1 / HOT_SHARE of the rows looked up by a shuffle are dealt over SALTS places
HOT_SHARE, SALTS = 512, 64


def _tagged(sources: dict[str, DataFrame], columns: list[str] | None = None) -> DataFrame:
    """All rows that can be referred to, as (_dataset, _idx, columns)."""
    tagged = None
    for name, frame in sources.items():
        chosen = [c for c in frame.columns if c != "idx"] if columns is None else columns
        part = frame.select(F.lit(name).alias("_dataset"), F.col("idx").alias("_idx"), *chosen)
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged


def reference_name(reference: Column) -> Column:
    """The name of a stored reference's dataset: path, name and split of its arguments, joined by slashes."""
    args = reference["dataset_args"]
    return F.concat_ws("/", args["path"], args["name"], args["split"])


def _target(refs: DataFrame, dataset: str, idx: str, reference: str | None) -> tuple[Column, Column]:
    if reference is None:
        return F.col(dataset), F.col(idx)
    return reference_name(F.col(reference)), F.col(reference)["idx"]


def attach_refs(
    refs: DataFrame, sources: dict[str, DataFrame], dataset: str = "dataset", idx: str = "idx", reference: str | None = None, verdict: str = "verdict"
) -> DataFrame:
    """Attach to every reference the columns of the row it names, and a ``verdict``: ``resolved``, or ``dangling`` and NULLs.

    A reference is a dataset name and a row number in two columns, or, with ``reference``, a struct as the builders store
    it (``dataset_args`` with path, name and split, and ``idx``). ``sources`` maps a name (``reference_name``) to a frame
    with an ``idx`` column; all have the same columns. Row numbers are unique per dataset, so only the reference side can
    be skewed (many references to one row), which adaptive execution splits; a small dataset is broadcast by its size.
    One left join, in which both sides are read once.
    """
    name, number = _target(refs, dataset, idx, reference)
    rows = _tagged(sources)
    columns = [c for c in rows.columns if c not in ("_dataset", "_idx")]
    found = rows.select("_dataset", "_idx", F.struct(*columns).alias("_row"))
    met = refs.withColumn("_dataset", name).withColumn("_idx", number).join(found, ["_dataset", "_idx"], "left")
    outcome = F.when(F.col("_row").isNull(), "dangling").otherwise("resolved")
    return met.select(*refs.columns, *[F.col("_row")[c].alias(c) for c in columns], outcome.alias(verdict))


def resolve_refs(
    refs: DataFrame, sources: dict[str, DataFrame], dataset: str = "dataset", idx: str = "idx", reference: str | None = None
) -> DataFrame:
    """``attach_refs`` without the references to rows that do not exist (see ``dangling_refs``)."""
    return attach_refs(refs, sources, dataset, idx, reference, "_verdict").filter(F.col("_verdict") == "resolved").drop("_verdict")


def dangling_refs(
    refs: DataFrame, sources: dict[str, DataFrame], dataset: str = "dataset", idx: str = "idx", reference: str | None = None
) -> DataFrame:
    """References that name no row."""
    name, number = _target(refs, dataset, idx, reference)
    keyed = refs.withColumn("_dataset", name).withColumn("_idx", number)
    return keyed.join(_tagged(sources, []), ["_dataset", "_idx"], "left_anti").drop("_dataset", "_idx")


def keep_existing(df: DataFrame, manifest: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file is listed in the manifest. A duplicate listing does not duplicate rows."""
    return df.join(manifest.select(F.col("path").alias(path)), path, "left_semi")


def missing_files(df: DataFrame, manifest: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file is not listed, NULL paths included."""
    return df.join(manifest.select(F.col("path").alias(path)), path, "left_anti")


def row_bytes(df: DataFrame, columns: list[str]) -> Column:
    """Rough size of a row: bytes of texts, eight for each number, the printed size of anything nested, and an overhead."""
    total = F.lit(32).cast("bigint")
    for name in columns:
        kind = df.schema[name].dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = F.octet_length(name)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            size = F.size(name) * 8 + 16
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            size = F.octet_length(F.to_json(name)) * 2
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(0)).cast("bigint")
    return total


def _head_floor(dim: DataFrame, columns: list[str], freq: str, limit: int) -> int:
    """Least frequency from which on the rows of ``dim`` fit ``limit`` bytes in all; 0 if the whole table does.

    Rows are counted by frequency class, sixteen to each doubling, so the driver sees at most a thousand sums whatever
    the table holds, and one huge row only weighs on its own class.
    """
    kind = F.floor(F.log2(F.greatest(F.col(freq), F.lit(1)).cast("double")) * 16).cast("int").alias("class")
    classes = dim.groupBy(kind).agg(F.sum(row_bytes(dim, columns)).alias("bytes"), F.min(freq).alias("least")).collect()
    used, floor = 0, None
    for c in sorted(classes, key=lambda c: -c["class"]):
        used += c["bytes"]
        if used > limit:
            return floor if floor is not None else 1 << 62
        floor = c["least"]
    return 0


def hot_keys(keys: DataFrame, key: str, share: int = HOT_SHARE) -> list:
    """The keys that make up at least 1 / ``share`` of the rows, NULL aside, and maybe some that nearly do.

    A sketch of frequent items is filled in the tasks and merged: one pass, a few thousand counters each. It is off by less
    than a fraction of that share.
    """
    sketch = F.call_function("approx_top_k", F.col(key), F.lit(share), F.lit(16 * share))
    row = keys.filter(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("n"), sketch.alias("top")).first()
    return [r["item"] for r in row["top"] or [] if r["count"] * share >= row["n"]]


def attach_by_frequency(
    facts: DataFrame, dim: DataFrame, key: str, freq: str = "freq", max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Left join of ``facts`` with a dimension of unique keys whose ``freq`` column tells how often a key occurs in them.

    Words follow a steep frequency curve: a few keys make up most rows. The most frequent rows of the dimension are
    broadcast as far as they fit the limit, counted in bytes; what they don't find is looked up in the rest by a shuffle,
    in which no known key has more rows than the least frequent one broadcast. Rows whose key was found or is NULL are
    spread over all partitions there. Keys that turn out hot although the dimension does not tell (it lacks them, or its
    ``freq`` comes from other data) are found by a sketch over what is to be looked up and dealt over ``SALTS`` places.

    ``dim`` is read several times: pass a staged table. The facts are read once, and once more for the sketch, of which only
    the key is kept.
    """
    columns = [c for c in dim.columns if c not in (key, freq)]
    floor = _head_floor(dim, [key, *columns], freq, max_broadcast_bytes)
    if floor == 0:
        return facts.join(F.broadcast(dim.drop(freq)), key, "left")
    order = [*facts.columns, *columns]
    row = F.struct(*columns)
    head = dim.filter(F.col(freq) >= floor).select(key, row.alias("_head"))
    met = facts.join(F.broadcast(head), key, "left").withColumn("_key", F.when(F.col("_head").isNull(), F.col(key)))
    hot = F.col("_key").isin(hot_keys(met.select("_key"), "_key"))
    places = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    tail = dim.filter(F.col(freq) < floor).select(F.col(key).alias("_key"), row.alias("_tail")).withColumn("_salt", F.explode(places))
    number = F.monotonically_increasing_id()
    salt = F.when(F.col("_key").isNull(), F.pmod(number, F.lit(1 << 16))).when(hot, F.pmod(number, F.lit(SALTS))).otherwise(F.lit(0))
    salted = met.withColumn("_salt", salt.cast("int"))
    found = salted.join(tail, ["_key", "_salt"], "left").withColumn("_row", F.coalesce("_head", "_tail"))
    return found.select(*facts.columns, *[F.col("_row").getField(c).alias(c) for c in columns]).select(*order)


def _field(name: str):
    return lambda row: row[name]


def gather_rows(draws: DataFrame, data: DataFrame, example: str, fields: list[str]) -> DataFrame:
    """Per example the drawn rows' fields as arrays, in drawn order.

    ``draws`` has (example, slot, idx), ``data`` has ``idx`` and the fields. An example has as many entries as rows
    were drawn for it, a small bounded number.
    """
    joined = draws.join(data.select("idx", *fields), "idx")
    ordered = joined.groupBy(example).agg(
        F.array_sort(F.collect_list(F.struct("slot", *[F.col(f).alias(f"_{f}") for f in fields]))).alias("_rows")
    )
    return ordered.select(example, *[F.transform("_rows", _field(f"_{f}")).alias(f) for f in fields])
