"""Concatenate datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.sampling import shuffle_dataset
from chatloom.session import stage


def concatenate(datasets: list[DataFrame]) -> DataFrame:
    """All rows of all datasets, duplicates kept; item columns a dataset lacks become NULL (read as no items)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), datasets)


def _number_copies(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``_nth``: 0, 1, ... among the rows with equal ``keys``, ordered by content.

    Rows are ranked within their input partition, the partitions' first ranks come from one count for each, so an id
    that fills a third of the data is numbered by as many tasks as hold it. Equal rows are interchangeable.
    """
    group = [*keys, "_content", "_part"]
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_content", "_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*group).orderBy("_row"))
    return rows.withColumn("_i", inside).join(firsts, group).withColumn("_nth", F.col("_first") + F.col("_i") - 1)


def merge_datasets(datasets: list[DataFrame], key: str = "id", salt: str = "merge") -> DataFrame:
    """Concatenate and shuffle: ``position`` counts the rows of all datasets in random order.

    ``dataset_no`` keeps equal ids of different datasets apart. Rows with equal ids are all kept and numbered by their
    content, so positions don't depend on how the datasets are partitioned. The inputs are evaluated once.
    """
    numbered = [d.withColumn("dataset_no", F.lit(i).cast("bigint")) for i, d in enumerate(datasets)]
    rows = concatenate(numbered)
    content = F.md5(F.to_json(F.struct(*[F.col(c) for c in rows.columns])))
    staged = stage(
        rows.select("*", F.monotonically_increasing_id().alias("_row"), F.spark_partition_id().alias("_part"), content.alias("_content")),
        "merged",
    )
    narrow = _number_copies(staged.select("_row", "_part", "_content", "dataset_no", F.col(key).alias("_key")), ["dataset_no", "_key"])
    first = F.col("_nth") == 0
    unique = F.when(first, F.col("_key")).otherwise(F.concat_ws("#", "_key", "_nth"))
    order = shuffle_dataset(narrow.select("_row", "dataset_no", unique.alias("_unique")), ["dataset_no", "_unique"], salt)
    return staged.join(order.select("_row", "position"), "_row").select(*rows.columns, "position")
