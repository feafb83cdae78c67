"""Folders of ``*.arrow`` files, as the ``datasets`` library saves them, as a Spark data source.

Layout: Arrow streams in ``data-00000-of-00002.arrow`` and so on, ``state.json`` with the files in their order, and
``dataset_info.json`` with the features. A folder without the two JSON files, and files in Arrow's random access format,
are read as well.

**Reading.** A file is dealt to tasks by byte ranges; a task reads the record batches that begin in its range. It finds them
by walking the messages of the mapped file, whose bodies it does not touch; files on other systems than a mounted one are not
split. Only the columns of the schema asked for are decoded. ``file`` and ``row``, if wanted, tell a row's place.

**Writing.** Tasks write below ``_temporary`` under names of their own; when all are done the committed files move to their
place in the order of the partitions, and ``state.json`` is written last. A failed or repeated task leaves nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

FORMAT = "arrow_folder"
SPLIT_BYTES = 128 << 20
SLICE_ROWS = 10_000
MAGIC = b"ARROW1"
PLACE = ("file", "row")
TEMPORARY = "_temporary"


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a path or URI."""
    path = re.sub(r"\Afile:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def arrow_files(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a dataset in its order: as ``state.json`` lists them, else by name."""
    system, folder = open_path(path)
    listed = system.get_file_info(pafs.FileSelector(folder))
    sizes = {f.path: f.size for f in listed if f.type == pafs.FileType.File}
    state = next((p for p in sizes if p.endswith("/state.json")), None)
    if state is not None:
        with system.open_input_stream(state) as f:
            names = [f"{folder.rstrip('/')}/{d['filename']}" for d in json.loads(f.read())["_data_files"]]
    else:
        names = sorted(p for p in sizes if p.endswith(".arrow"))
    missing = [n for n in names if n not in sizes]
    if missing or not names:
        raise FileNotFoundError(f"{path}: {', '.join(missing[:3]) or 'no *.arrow files'}")
    return [(n, sizes[n]) for n in names]


def plain_type(kind: pa.DataType) -> pa.DataType:
    """The type in which Spark takes a column: no dictionaries, unsigned or half numbers, large or fixed-size lists."""
    t = pa.types
    narrow = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32(), pa.null(): pa.string(), pa.large_string(): pa.string(), pa.large_binary(): pa.binary()}
    if t.is_dictionary(kind):
        return plain_type(kind.value_type)
    if t.is_list(kind) or t.is_large_list(kind) or t.is_fixed_size_list(kind):
        return pa.list_(plain_type(kind.value_type))
    if t.is_struct(kind):
        return pa.struct([pa.field(f.name, plain_type(f.type)) for f in kind])
    return narrow.get(kind, kind)


def plain_schema(schema: pa.Schema) -> T.StructType:
    return from_arrow_schema(pa.schema([pa.field(f.name, plain_type(f.type)) for f in schema]))


def _has_dictionaries(kind: pa.DataType) -> bool:
    return pa.types.is_dictionary(kind) or any(_has_dictionaries(kind.field(i).type) for i in range(kind.num_fields))


@dataclass
class FileRange(InputPartition):
    """The record batches of a file that begin at ``start`` <= byte < ``end``."""

    number: int
    path: str
    size: int
    start: int
    end: int


def _open(system: pafs.FileSystem, path: str) -> pa.NativeFile:
    return pa.memory_map(path) if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(path)


def read_batches(share: FileRange, path: str, with_rows: bool) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(number of the first row in the file, batch) of a share; rows are numbered if ``with_rows``."""
    system, _ = open_path(path)
    with _open(system, share.path) as source:
        if source.read(len(MAGIC)) == MAGIC:
            reader, row = pa.ipc.open_file(source), 0
            for i in range(reader.num_record_batches):
                mine = share.start <= share.size * i // reader.num_record_batches < share.end
                if mine or with_rows:
                    batch = reader.get_batch(i)
                    if mine:
                        yield row, batch
                    row += batch.num_rows
            return
        source.seek(0)
        schema, row = pa.ipc.read_schema(source), 0
        if any(_has_dictionaries(f.type) for f in schema):  # their batches need all that came before
            if share.start == 0:
                source.seek(0)
                for batch in pa.ipc.open_stream(source):
                    yield row, batch
                    row += batch.num_rows
            return
        while (at := source.tell()) < share.end:
            try:
                message = pa.ipc.read_message(source)
            except EOFError:
                return
            if message is None:
                return
            if at >= share.start or with_rows:
                batch = pa.ipc.read_record_batch(message, schema)
                if at >= share.start:
                    yield row, batch
                row += batch.num_rows


class FolderReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, split: int) -> None:
        self.path, self.schema, self.split = path, schema, split

    def partitions(self) -> list[FileRange]:
        whole = not isinstance(open_path(self.path)[0], pafs.LocalFileSystem)
        shares = []
        for number, (name, size) in enumerate(arrow_files(self.path)):
            n = 1 if whole else max(1, -(-size // self.split))
            edges = [size * i // n for i in range(n)] + [size + 1]
            shares += [FileRange(number, name, size, a, b) for a, b in zip(edges, edges[1:])]
        return shares

    def read(self, share: FileRange) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.schema)
        with_rows = "row" in wanted.names
        for first, batch in read_batches(share, self.path, with_rows):
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(begin, SLICE_ROWS)
                yield self._columns(part, wanted, share.number, first + begin)

    def _columns(self, part: pa.RecordBatch, wanted: pa.Schema, number: int, first: int) -> pa.RecordBatch:
        own, columns = set(part.schema.names), []
        for f in wanted:
            if f.name in own:
                column = part.column(f.name)
                columns.append(column if column.type == f.type else _cast(column, f.type))
            elif f.name == "file":
                columns.append(pa.array([number] * part.num_rows, f.type))
            elif f.name == "row":
                columns.append(pa.array(range(first, first + part.num_rows), f.type))
            else:
                columns.append(pa.nulls(part.num_rows, f.type))
        return pa.RecordBatch.from_arrays(columns, schema=wanted)


def _cast(column: pa.Array, kind: pa.DataType) -> pa.Array:
    return column.cast(plain_type(column.type)).cast(kind)


# ---- writing -----------------------------------------------------------------------------------------------


def feature(kind: T.DataType) -> dict | list:
    """A column's entry in ``dataset_info.json``."""
    # fixed values: names of the types
    names = {
        "string": "string", "bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8", "double": "float64", "float": "float32",
        "boolean": "bool", "binary": "binary", "date": "date32", "timestamp": "timestamp[us, tz=UTC]", "timestamp_ntz": "timestamp[us]",
    }
    if isinstance(kind, T.StructType):
        return {f.name: feature(f.dataType) for f in kind}
    if isinstance(kind, T.ArrayType):
        inner = feature(kind.elementType)
        return [inner] if isinstance(kind.elementType, T.StructType) else {"feature": inner, "_type": "Sequence"}
    if isinstance(kind, T.DecimalType):
        return {"dtype": f"decimal128({kind.precision}, {kind.scale})", "_type": "Value"}
    return {"dtype": names[kind.simpleString()], "_type": "Value"}


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str | None


class FolderWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema = path.rstrip("/"), schema
        features = {f.name: feature(f.dataType) for f in schema}
        self.info = {"citation": "", "description": "", "features": features, "homepage": "", "license": ""}

    def _arrow_schema(self) -> pa.Schema:
        return to_arrow_schema(self.schema).with_metadata({"huggingface": json.dumps({"info": {"features": self.info["features"]}})})

    def _stream(self, name: str, batches: Iterator[pa.RecordBatch]) -> None:
        system, folder = open_path(self.path)
        system.create_dir(f"{folder}/{TEMPORARY}", recursive=True)
        schema = self._arrow_schema()
        with system.open_output_stream(f"{folder}/{TEMPORARY}/{name}") as sink, pa.ipc.new_stream(sink, schema) as out:
            for batch in batches:
                out.write_batch(batch.cast(schema) if batch.schema != schema else batch)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        partition = TaskContext.get().partitionId()
        first = next((b for b in iterator if b.num_rows), None)
        if first is None:
            return Written(partition, None)
        name = f"{partition:08d}-{uuid.uuid4().hex}"

        def rest() -> Iterator[pa.RecordBatch]:
            yield first
            yield from iterator

        self._stream(name, rest())
        return Written(partition, name)

    def commit(self, messages: list[Written]) -> None:
        system, folder = open_path(self.path)
        done = [m.file for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition) if m.file]
        if not done:
            done = ["empty"]
            self._stream("empty", iter(()))
        names = [f"data-{i:05d}-of-{len(done):05d}.arrow" for i in range(len(done))]
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda pair: system.move(f"{folder}/{TEMPORARY}/{pair[0]}", f"{folder}/{pair[1]}"), zip(done, names)))
        system.delete_dir(f"{folder}/{TEMPORARY}")
        state = {
            "_data_files": [{"filename": n} for n in names],
            "_fingerprint": uuid.uuid4().hex[:16],
            "_format_columns": None,
            "_format_kwargs": {},
            "_format_type": None,
            "_output_all_columns": False,
            "_split": None,
        }
        for name, content in (("dataset_info.json", self.info), ("state.json", state)):
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(json.dumps(content, indent=2).encode())

    def abort(self, messages: list[Written]) -> None:
        system, folder = open_path(self.path)
        if system.get_file_info(f"{folder}/{TEMPORARY}").type == pafs.FileType.Directory:
            system.delete_dir(f"{folder}/{TEMPORARY}")


class ArrowFolder(DataSource):
    """Options: ``path``; ``place`` ("true": columns ``file`` and ``row``); ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        path = self.options["path"]
        system, _ = open_path(path)
        with _open(system, arrow_files(path)[0][0]) as source:
            is_file = source.read(len(MAGIC)) == MAGIC
            source.seek(0)
            found = plain_schema(pa.ipc.open_file(source).schema if is_file else pa.ipc.read_schema(source))
        if self.options.get("place", "false").lower() == "true":
            clash = [n for n in PLACE if n in found.names]
            if clash:
                raise ValueError(f"{path} has columns {clash} of its own")
            found = T.StructType(found.fields + [T.StructField("file", T.IntegerType()), T.StructField("row", T.LongType())])
        return found

    def reader(self, schema: T.StructType) -> FolderReader:
        return FolderReader(self.options["path"], schema, int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options["path"], schema)


def read_arrow(
    spark: SparkSession, path: str, columns: list[str] | T.StructType | None = None, place: bool = False, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """The dataset in a folder of ``*.arrow`` files; ``columns`` (names, or a schema) limits what is decoded.

    With ``place`` two more columns tell where a row stands: ``file``, its file's number, and ``row``, its number there.
    Files that lack a column give NULLs. A folder without files is an error, a file without rows is none.
    """
    spark.dataSource.register(ArrowFolder)
    reader = spark.read.format(FORMAT).option("place", place).option("splitBytes", split_bytes)
    if isinstance(columns, list):
        found = ArrowFolder({"path": path, "place": str(place)}).schema()
        columns = T.StructType([found[c] for c in columns] + [f for f in found if place and f.name in PLACE and f.name not in columns])
    return (reader.schema(columns) if columns is not None else reader).load(path)


def write_arrow(df: DataFrame, path: str) -> None:
    """Save ``df`` as such a folder, one file for each partition that has rows, in their order.

    The folder must not hold a dataset yet. An empty frame gives one file without rows.
    """
    system, folder = open_path(path)
    if system.get_file_info(folder).type != pafs.FileType.NotFound and system.get_file_info(pafs.FileSelector(folder)):
        raise FileExistsError(path)
    df.sparkSession.dataSource.register(ArrowFolder)
    df.write.format(FORMAT).mode("append").save(path)
