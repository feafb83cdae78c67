"""Listing large trees of files in tasks.

The folders of one level are listed side by side, and those found there make the next level: as many rounds as the tree is
deep, each staged. The driver handles no name below the root. One task lists a folder's own entries, as a stream on a
mounted file system.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.session import stage
from chatloom.sources.arrow_files import open_path

BATCH = 10_000
ENTRY_SQL = "path string, length bigint, folder boolean"


def entries(folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path, bytes, whether it is a folder) of what lies in a folder; names that begin with ``_`` or ``.`` are hidden."""
    system, inner = open_path(folder)
    if isinstance(system, pafs.LocalFileSystem):
        with os.scandir(inner) as found:
            for e in found:
                if e.name[0] not in "._":
                    is_folder = e.is_dir()
                    yield e.path, 0 if is_folder else e.stat().st_size, is_folder
        return
    scheme = folder[: len(folder) - len(inner)] if folder.endswith(inner) else folder.partition("://")[0] + "://"
    for e in system.get_file_info(pafs.FileSelector(inner)):
        if e.base_name[0] not in "._":
            yield scheme + e.path, e.size or 0, e.type == pafs.FileType.Directory


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, int, bool]] = []

    def flush() -> pa.RecordBatch:
        columns = [pa.array([e[i] for e in held], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_()))]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=["path", "length", "folder"])

    for batch in batches:
        for folder in batch.column(0).to_pylist():
            for e in entries(folder):
                held.append(e)
                if len(held) == BATCH:
                    yield flush()
    if held:
        yield flush()


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, length`` of every file below ``root``. Links to folders are followed: a tree must not link to itself."""
    level, files = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string"), None
    while True:
        found = stage(level.repartition("path").mapInArrow(_list, ENTRY_SQL), "listed")
        own = found.filter(~F.col("folder")).select("path", "length")
        files = own if files is None else files.unionByName(own)
        level = found.filter("folder").select("path")
        if level.isEmpty():
            return files
