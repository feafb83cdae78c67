import json

import pytest
from pyspark.sql import functions as F

from chatloom.plans import builders
from chatloom.schemas import DIALOG
from chatloom.sources import files
from chatloom.sources.card import dataset_card
from chatloom.registry import bundle


def dialogs(spark, rows):
    return spark.createDataFrame([(i, img, [{"from": f, "value": v} for f, v in turns]) for i, img, turns in rows], DIALOG)


TURNS = [("human", "<image>\nsee the photo"), ("gpt", "a seed")]


def manifest(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_image_builders(spark):
    df = dialogs(spark, [("1", "a/b/c.jpg", TURNS), ("2", "a/b/gone.jpg", TURNS), ("3", None, TURNS)])
    m = manifest(spark, "/r/a/b/c.jpg", "/r/a/b/b/c.jpg")
    fine = builders.image_finetune(df, "/r", m).collect()
    assert [(r["id"], r["images"]) for r in fine] == [("1", ["/r/a/b/b/c.jpg"])]
    assert [tuple(x) for x in fine[0]["messages"]] == [("user", "<image>\nsee the photo"), ("assistant", "a seed")]
    # the pretrain build needs an image in every row
    with pytest.raises(Exception, match="no image"):
        builders.image_pretrain(df, "/r", m).collect()
    assert [r["id"] for r in builders.image_pretrain(df, "/r", m, "reject").collect()] == ["1"]


def test_strict_builds_fail_on_bad_rows(spark):
    m = manifest(spark, "/r/x.jpg", "/r/a/a/b.jpg", "/r/a/b.jpg")
    with pytest.raises(Exception, match="one segment"):
        builders.image_finetune(dialogs(spark, [("1", "x.jpg", TURNS)]), "/r", m).collect()
    odd = dialogs(spark, [("1", "a/b.jpg", [("robot", "x")])])
    with pytest.raises(Exception, match="unknown role"):
        builders.image_pretrain(odd, "/r", m).collect()
    assert builders.image_pretrain(odd, "/r", m, "reject").count() == 0


def test_crossmodal_builders(spark):
    df = dialogs(spark, [("1", "a/b/c.jpg", TURNS), ("2", "ocr/b/c.jpg", TURNS), ("3", "a/b/c.jpg", [("human", "the Right side")])])
    m = manifest(spark, "/r/a/b/c.jpg", "/r/a/b/b/c.jpg", "/r/ocr/b/b/c.jpg")
    got = builders.crossmodal_finetune(df, "/r", m).collect()
    assert [r["id"] for r in got] == ["1"] and got[0]["messages"][0]["content"].startswith("<imagebind>\n")
    by_kind = {
        "<imagebind>\nhear the sound": "a heard",
        "<imagebind>\nsee the photo": "a seed",
        "<imagebind>\nread the text": "a readd",
    }
    assert by_kind[got[0]["messages"][0]["content"]] == got[0]["messages"][1]["content"]


def test_document_pretrain_caps_and_counts(spark):
    long = " ".join("word " * 300 + "." for _ in range(6))
    df = spark.createDataFrame([("short", "One. Two."), ("long", long), ("empty", "")], "title string, text string")
    got = {r["id"]: r for r in builders.document_pretrain(df).collect()}
    assert set(got) == {"short", "empty"}
    assert got["short"]["documents"] == ["One. Two."] and got["empty"]["documents"] == [""]
    assert got["short"]["messages"][0]["content"].count("<document>") == 1
    assert got["short"]["messages"][1]["content"] == "One. Two."


def test_speech_text_column(spark):
    a = spark.createDataFrame([(0, "s", "t")], "idx long, sentence string, text string")
    assert a.select(builders.speech_text(a)).first()[0] == "t"
    b = a.drop("text")
    row = builders.speech_pretrain(b).first()
    assert row["messages"][1]["content"] == "s" and row["speech_audios"][0]["idx"] == 0


def test_video_rows(spark):
    clips = spark.createDataFrame(
        [(0, "x", "00:00:01.5", "00:00:02", "c"), (1, "y", "1:2", "00:00:02", "c"), (2, None, "00:00:01", "00:00:02", "c")],
        "clip_id long, video_id string, start string, end string, caption string",
    )
    got = builders.video_pretrain(clips).collect()
    assert [tuple(r["videos"][0]) for r in got] == [("https://www.youtube.com/watch?v=x", 1.5, 2.0)]
    assert builders.video_pretrain(clips, max_examples=1).count() <= 1


def test_policy_rows(spark):
    df = spark.range(5).select(F.lit(1).alias("round"), F.col("id").alias("frame"), F.col("id").alias("action"))
    got = {r["id"]: r for r in builders.policy_rows(df, "/f", rate=1.0).collect()}
    assert [got[f"1_{i}"]["messages"][1]["content"] for i in range(5)] == [
        "[NOTHING]", "[FIRE LEFT ENGINE]", "[FIRE MAIN ENGINE]", "[FIRE RIGHT ENGINE]", "",
    ]
    assert got["1_0"]["images"] == ["/f/1_0.jpg"]


def test_sources(spark, tmp_path):
    for i, part in enumerate((["1", "2"], ["3"])):
        (tmp_path / f"d{i}.json").write_text(json.dumps([{"id": k, "conversations": [{"from": "gpt", "value": "é"}]} for k in part], indent=1))
    got = files.read_dialog_json(spark, [str(tmp_path / "d0.json"), str(tmp_path / "d1.json")])
    assert sorted(r["id"] for r in got.collect()) == ["1", "2", "3"] and got.filter("image is not null").count() == 0

    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.jsonl").write_text('{"text":"x"}\n{"text":\n')
    schema = spark.createDataFrame([], "text string").schema
    kept = files.read_jsonl(spark, str(lines / "*.jsonl"), schema, corrupt="bad").collect()
    assert sorted((r["text"] or "", r["bad"] or "") for r in kept) == [("", '{"text":'), ("x", "")]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(lines / "*.jsonl"), schema).collect()

    listed = files.read_manifest(spark, str(tmp_path)).collect()
    assert str(lines / "a.jsonl") in {r["path"] for r in listed}

    chats = spark.createDataFrame([("a", ["i"])], "id string, images array<string>")
    files.write_chat(chats, str(tmp_path / "chat"))
    assert files.read_chat(spark, str(tmp_path / "chat")).collect() == chats.collect()
    chats.createOrReplaceTempView("chats_by_name")
    assert files.read_chat(spark, "chats_by_name").collect() == chats.collect()

    for _ in range(2):
        assert builders.cached(chats, str(tmp_path / "cache")).collect() == chats.collect()
    assert spark.read.json(str(tmp_path / "cache")).count() == 2


def test_shuffled_files_hold_consecutive_positions(spark, tmp_path):
    from chatloom.operators.sampling import shuffle_dataset

    files.write_shuffled(shuffle_dataset(spark.range(100), ["id"]), str(tmp_path / "s"), 4)
    back = files.read_chat(spark, str(tmp_path / "s")).withColumn("f", F.input_file_name())
    rows = back.groupBy("f").agg(F.min("position").alias("a"), F.max("position").alias("b"), F.count("id").alias("n")).collect()
    assert sorted((r["a"], r["b"], r["n"]) for r in rows) == [(0, 24, 25), (25, 49, 25), (50, 74, 25), (75, 99, 25)]
    files.write_shuffled(spark.createDataFrame([], "id long, position long"), str(tmp_path / "e"), 4)
    assert files.read_chat(spark, str(tmp_path / "e")).count() == 0


def test_training_batches_and_requests(spark):
    from chatloom.operators import encoding
    from chatloom.plans.batches import requests, training_batches
    from chatloom.registry import ModalitySpec
    from chatloom.schemas import chat_schema

    spec = ModalitySpec("toy", "<toy>", "toys", 2)
    chats = [
        [("user", "<toy> a"), ("assistant", "b")],
        [("assistant", "bad")],
        [("user", "c")],
        [("user", "<toy> x y"), ("assistant", "stray <toy>")],
    ]
    data = [(str(i), [f"t{i}"], [{"role": r, "content": c} for r, c in turns], i) for i, turns in enumerate(chats)]
    schema = chat_schema("toys").add("idx", "long")
    df = spark.createDataFrame(data, schema).drop("id")
    got = training_batches(df, "idx", [spec], 2, 7, {"unk": 0, "pad": None}).orderBy("idx").collect()
    assert [(r["idx"], r["source"], r["batch_id"], r["toys"]) for r in got] == [
        (0, 0, 0, ["t0"]), (1, 2, 0, ["t2"]), (2, 2, 1, ["t2"]), (3, 0, 1, ["t0"]),
    ]
    assert {len(r["input_ids"]) for r in got} == {7} and sum(got[1]["attention_mask"]) == 4
    vocab = encoding.build_vocab(spark.createDataFrame([("c",), ("<s>",)], "token string"))
    waiting = requests(df, "idx", [spec], vocab).collect()
    assert [(r["idx"], r["input_ids"], r["prompt_length"]) for r in waiting] == [(2, [1, 0, 3, 0], 4)]


def test_card(spark):
    df = spark.createDataFrame([(3, "x"), (1, "y")], "id long, m string")
    row = dataset_card(df, "id", bundle("audio_clap")).first()
    assert row["num_examples"] == 2 and json.loads(row["first_example"]) == {"id": 1, "m": "y"}
    assert row["modalities"] == "* audio_clap (use `<sound>` in text and provide `sounds`, encoded as 5 tokens)"


def test_generated_rows_make_a_round_trip(spark, tmp_path):
    """The model is handed prompts for just the attempts asked for; what it answered is in the cache as built."""
    sounds = spark.range(20).select(F.col("id").alias("idx"), F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("tag "), "id").alias("tags"))
    asked = []

    def model(requests):
        asked.append(requests)
        good = F.to_json(F.struct(F.lit("q").alias("question"), F.col("prompt").alias("answer")))
        return requests.select("shard", "attempt", F.when(F.col("attempt") % 9 == 0, good).otherwise("{").alias("response"))

    cache = str(tmp_path / "cache")
    rows = builders.sound_generated(spark, sounds, model, shards=2, quota=3, cache=cache).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, i) for s in range(2) for i in range(3)]
    for r in rows:
        assert f"tag {r['sounds'][0][1:]}\n" in r["messages"][1]["content"]
    assert len(asked) > 1 and "prompt" in asked[0].columns
    assert sorted(r["id"] for r in spark.read.json(cache).collect()) == sorted(r["id"] for r in rows)
    with pytest.raises(ValueError):
        builders.sound_generated(spark, sounds.filter("idx <> 5"), model, 2, 3)


def test_manifest_from_an_inventory(spark, tmp_path):
    spark.createDataFrame([("/a/x", 1), ("/a/b/y", 2), ("/ab/z", 3)], "path string, length int").write.parquet(str(tmp_path / "inventory"))
    assert sorted(map(tuple, files.read_manifest(spark, "/a", str(tmp_path / "inventory")).collect())) == [("/a/b/y", 2), ("/a/x", 1)]


def test_manifest_listed_in_tasks(spark, tmp_path):
    want = {}
    for i in range(60):
        folder = tmp_path / f"f{i % 7}" / f"g{i % 3}" if i % 5 else tmp_path
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"x {i}.bin").write_bytes(b"y" * i)
        want[str(folder / f"x {i}.bin")] = i
    (tmp_path / "empty").mkdir()
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "z").write_bytes(b"z")
    (tmp_path / ".crc").write_bytes(b"z")
    for root in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}"):
        assert dict(map(tuple, files.read_manifest(spark, root).collect())) == want


def test_written_files_are_even(spark, tmp_path):
    rows = spark.range(100_000).withColumnRenamed("id", "position").repartition(7)
    files.write_shuffled(rows, str(tmp_path / "even"), 16)
    by = spark.read.parquet(str(tmp_path / "even")).groupBy(F.input_file_name()).agg(F.count("position").alias("n"), F.min("position").alias("a"), F.max("position").alias("b")).collect()
    assert len(by) == 16 and {r["n"] for r in by} == {6250} and all(r["b"] - r["a"] == 6249 for r in by)


def test_staged_folders_are_dropped(spark, tmp_path):
    import os

    from chatloom import session

    kept, session._staged[:] = session._staged[:], []
    path = session.staging_path(spark, "x")
    spark.range(3).write.parquet(path)
    folder = os.path.dirname(path.removeprefix("file:"))
    assert os.path.isdir(folder)
    session.drop_staged()
    assert not os.path.exists(folder)
    session._staged[:] = kept
