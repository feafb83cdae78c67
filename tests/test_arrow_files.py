import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatloom.sources import files
from chatloom.sources.arrow_files import FolderWriter, arrow_files, read_arrow, write_arrow


def saved(folder, tables, state=None, new=pa.ipc.new_stream, rows=3):
    os.makedirs(folder, exist_ok=True)
    for name, table in tables.items():
        with pa.OSFile(f"{folder}/{name}", "wb") as sink, new(sink, table.schema) as out:
            out.write_table(table, max_chunksize=rows)
    if state is not None:
        with open(f"{folder}/state.json", "w") as f:
            json.dump({"_data_files": [{"filename": n} for n in state]}, f)
    return str(folder)


def chats(start, n):
    messages = [[{"content": f"c{i}", "role": "user"}] * (i % 3) for i in range(start, start + n)]
    return pa.table({"id": [f"r{i}" for i in range(start, start + n)], "images": [[f"i{i}"] if i % 2 else None for i in range(start, start + n)], "messages": messages, "n": pa.array(range(start, start + n), pa.int64())})


@pytest.mark.parametrize("new", [pa.ipc.new_stream, pa.ipc.new_file])
@pytest.mark.parametrize("split", [1 << 30, 500])
def test_a_saved_dataset_is_read_in_its_order(spark, tmp_path, new, split):
    """Whatever the splits, every row once, with its place; state.json tells the order, not the names."""
    folder = saved(tmp_path / "d", {"b.arrow": chats(0, 20), "a.arrow": chats(20, 10)}, ["b.arrow", "a.arrow"], new)
    got = read_arrow(spark, folder, place=True, split_bytes=split)
    rows = got.collect()
    assert [r["n"] for r in rows] == list(range(30))
    assert [(r["file"], r["row"]) for r in rows] == [(0, i) for i in range(20)] + [(1, i) for i in range(10)]
    assert [len(r["messages"]) for r in rows] == [i % 3 for i in range(30)] and rows[1]["images"] == ["i1"] and rows[0]["images"] is None
    assert rows[2]["messages"][0].asDict() == {"content": "c2", "role": "user"}
    n = got.rdd.getNumPartitions()
    assert n == 2 if split > 500 else n > 4


def test_columns_without_state_and_other_types(spark, tmp_path):
    odd = pa.table(
        {
            "u": pa.array([1, 2], pa.uint32()), "h": pa.array([b"x", None], pa.large_binary()), "s": pa.array(["a", "b"], pa.large_string()),
            "v": pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float32(), 2)), "none": pa.nulls(2), "d": pa.array(["x", "y"]).dictionary_encode(),
        }
    )
    folder = saved(tmp_path / "odd", {"x.arrow": odd})
    row = read_arrow(spark, folder).first()
    assert row.asDict() == {"u": 1, "h": bytearray(b"x"), "s": "a", "v": [1.0, 2.0], "none": None, "d": "x"}
    assert read_arrow(spark, folder, ["s"]).columns == ["s"]
    assert [tuple(r) for r in read_arrow(spark, folder, ["s", "u"], place=True).collect()] == [("a", 1, 0, 0), ("b", 2, 0, 1)]
    saved(tmp_path / "odd", {"y.arrow": pa.table({"s": ["c"]})})  # a file that lacks columns
    assert [tuple(r) for r in read_arrow(spark, folder, ["s", "u"]).collect()] == [("a", 1), ("b", 2), ("c", None)]
    with pytest.raises(FileNotFoundError):
        arrow_files(saved(tmp_path / "none", {}))
    with pytest.raises(FileNotFoundError, match="gone"):
        arrow_files(saved(tmp_path / "odd", {}, ["gone.arrow"]))


def test_round_trip(spark, tmp_path):
    df = spark.range(1000).select(
        "id", F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"),
        F.array(F.lit(1.5)).alias("v"), F.when(F.col("id") % 2 == 0, "x").alias("t"), F.struct(F.lit(True).alias("b"), F.lit(1).alias("i")).alias("s"),
    ).repartitionByRange(5, "id").sortWithinPartitions("id")
    path = str(tmp_path / "out")
    write_arrow(df, path)
    assert sorted(os.listdir(path)) == [f"data-{i:05d}-of-00005.arrow" for i in range(5)] + ["dataset_info.json", "state.json"]
    with open(f"{path}/dataset_info.json") as f:
        features = json.load(f)["features"]
    assert features["messages"] == [{"role": {"dtype": "string", "_type": "Value"}, "content": {"dtype": "string", "_type": "Value"}}]
    assert features["v"] == {"feature": {"dtype": "float64", "_type": "Value"}, "_type": "Sequence"} and features["id"]["dtype"] == "int64"
    with pa.OSFile(f"{path}/data-00000-of-00005.arrow") as f:
        assert json.loads(pa.ipc.open_stream(f).schema.metadata[b"huggingface"])["info"]["features"] == features
    back = files.read_chat(spark, path)
    assert back.dtypes == df.dtypes and back.collect() == df.collect()
    with pytest.raises(FileExistsError):
        write_arrow(df, path)


def test_an_empty_dataset(spark, tmp_path):
    path = str(tmp_path / "e")
    files.write_chat(spark.createDataFrame([], "id string, images array<string>"), path, layout="arrow")
    back = files.read_chat(spark, path)
    assert back.columns == ["id", "images"] and back.count() == 0 and len(arrow_files(path)) == 1


def test_a_failed_write_leaves_no_dataset(spark, tmp_path):
    path = str(tmp_path / "f")
    with pytest.raises(Exception):
        write_arrow(spark.range(10).select(F.raise_error(F.lit("no")).cast("string").alias("x")), path)
    assert not os.path.exists(path) or not [n for n in os.listdir(path) if n != "_temporary"]
    writer = FolderWriter(path, spark.range(1).schema)
    writer.abort([])
    assert not os.path.exists(f"{path}/_temporary")


def test_schema_asked_for(spark, tmp_path):
    folder = saved(tmp_path / "d", {"a.arrow": chats(0, 4)})
    schema = spark.createDataFrame([], "n int, id string, more double").schema
    assert [tuple(r) for r in files.read_chat(spark, folder, schema).collect()] == [(i, f"r{i}", None) for i in range(4)]
