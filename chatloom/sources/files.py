"""Dataset files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.schemas import DIALOG
from chatloom.session import stage
from chatloom.sources import json_arrays
from chatloom.sources.arrow_files import read_arrow, write_arrow
from chatloom.sources.listing import list_files


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_chat(spark: SparkSession, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A saved dataset: the path if it exists (a folder of ``*.arrow`` files, else Parquet), else the table of that name."""
    if not path_exists(spark, name):
        return spark.table(name)
    if is_arrow_folder(spark, name):
        return read_arrow(spark, name, schema)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(name)


def is_arrow_folder(spark: SparkSession, path: str) -> bool:
    glob = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/*.arrow")
    return bool(glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob))


def write_chat(df: DataFrame, path: str, mode: str = "errorifexists", layout: str = "parquet") -> None:
    """Save a dataset as Parquet or, with ``layout="arrow"``, as a new folder of ``*.arrow`` files (see ``arrow_files``)."""
    if layout == "arrow":
        write_arrow(df, path)
    else:
        df.write.mode(mode).parquet(path)


def write_shuffled(df: DataFrame, path: str, files: int, position: str = "position") -> None:
    """Write rows in the order of their position, spread over ``files`` files of consecutive positions.

    Positions are dense, so the file of a row is plain arithmetic and names its partition directly: no sampling of
    ranges, and even files. The rows are staged, so that they are evaluated once. The column stays in the files and
    serves as row index later.
    """
    rows = stage(df, "shuffled")
    share = F.greatest(F.lit(1), F.ceil((F.max(position) + 1) / files)).cast("bigint")
    size = rows.agg(F.coalesce(share, F.lit(1)).alias("s")).first()["s"]
    placed = rows.withColumn("_file", F.expr(f"cast(`{position}` div {size} as int)")).repartitionById(files, F.col("_file"))
    placed.sortWithinPartitions(position).drop("_file").write.parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_dialog_json(
    spark: SparkSession, paths: list[str] | str, schema: T.StructType = DIALOG, split_bytes: int = json_arrays.SPLIT_BYTES
) -> DataFrame:
    """Dialogues from files that each hold one JSON array.

    Files of up to ``split_bytes`` are read whole, one a task; larger ones in ranges of that size (see ``json_arrays``).
    An element that does not fit the schema gives NULLs.
    """
    sized = matching_files(spark, paths)
    large = [f for f in sized if f[1] > split_bytes]
    small = spark.read.schema(schema).json([p for p, n in sized if n <= split_bytes], multiLine=True)
    if not large:
        return small
    cut = json_arrays.read_elements(spark, large, split_bytes).select(F.from_json("value", schema).alias("r")).select("r.*")
    return cut if len(large) == len(sized) else small.unionByName(cut)


def matching_files(spark: SparkSession, paths: list[str] | str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that the paths or patterns name, those in named folders included."""
    found = []
    for pattern in [paths] if isinstance(paths, str) else paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        system = target.getFileSystem(spark._jsc.hadoopConfiguration())
        matched = system.globStatus(target)
        if not matched:
            raise FileNotFoundError(pattern)
        for status in matched:
            inside = system.listStatus(status.getPath()) if status.isDirectory() else [status]
            found += [(f.getPath().toString(), f.getLen()) for f in inside if f.isFile() and f.getPath().getName()[0] not in "._"]
    return found


def read_jsonl(spark: SparkSession, pattern: str | list[str], schema: T.StructType, corrupt: str | None = None) -> DataFrame:
    """Line-delimited JSON of one file or a glob; bad lines fail the read unless a ``corrupt`` column takes them."""
    if corrupt is None:
        return spark.read.schema(schema).json(pattern, mode="FAILFAST")
    wider = T.StructType(schema.fields + [T.StructField(corrupt, T.StringType())])
    return spark.read.schema(wider).json(pattern, mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt)


def read_manifest(spark: SparkSession, root: str, inventory: str | None = None) -> DataFrame:
    """``(path, length)`` of every file below ``root``; file contents are not read, hidden files are left out.

    With ``inventory``, a table (path or name) of ``path`` and ``length`` as object stores publish it, the files below
    ``root`` are taken from there: nothing is listed, and the work is a scan. Without it tasks list the folders.
    """
    if inventory is not None:
        listed = read_chat(spark, inventory).select("path", F.col("length").cast("bigint").alias("length"))
        return listed.filter(F.col("path").startswith(root.rstrip("/") + "/"))
    return list_files(spark, root).withColumn("path", F.regexp_replace("path", r"\Afile:/+", "/"))


def append_jsonl(df: DataFrame, folder: str) -> None:
    """Append rows as JSON lines; NULLs are written, and a task's rows stay even if the job fails after the task.

    A reader never sees half a file. A task that is repeated after it was committed may leave its rows twice: give them keys.
    """
    kept = {"mapreduce.fileoutputcommitter.algorithm.version": "2", "ignoreNullFields": "false"}
    df.write.mode("append").options(**kept).json(folder)


def write_cache_jsonl(df: DataFrame, folder: str) -> None:
    """Append accepted generated examples, so that paid results survive a later failure of the build."""
    append_jsonl(df, folder)
