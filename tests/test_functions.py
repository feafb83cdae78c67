import hashlib
import os
import posixpath

import pytest
from pyspark.sql import functions as F

from chatloom import fixed_values as fv
from chatloom.functions import hashing, media, text, vectors


def column(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def test_hash32_is_the_md5_prefix(spark):
    want = [int(hashlib.md5(f"salt:{v}".encode()).hexdigest()[:8], 16) for v in ("a", "7", "é")]
    assert column(spark, lambda c: hashing.hash32(c, "salt"), ["a", "7", "é"]) == want


def test_shuffled_keeps_all_values(spark):
    got = column(spark, lambda c: hashing.shuffled(c, "o", fv.LANDER_OPTIONS), [str(i) for i in range(30)])
    assert all(sorted(g) == sorted(fv.LANDER_OPTIONS) for g in got)
    assert len({tuple(g) for g in got}) > 5


def test_strip_equals_python(spark):
    values = [" a b \n", "\t\r\x0b\x0cx\x1c\x85", "  y  ", "", " \n ", "é", "a\nb", "​z​"]
    assert column(spark, text.strip, values) == [v.strip() for v in values]


def test_roles(spark):
    assert column(spark, text.normalize_role, ["gpt", "human", "system", "user", None]) == ["assistant", "user", None, None, None]


def test_reword_hand_case(one):
    got = one(lambda F: text.reword(F.col("c"), F.lit(0)), c=("string", "see <image> image seed"))
    assert got == "hear <imagebind> audio heard"
    got = one(lambda F: text.reword(F.col("c"), F.lit(2)), c=("string", "a visible picture, Look, looking"))
    assert got == "a readable text snippet, Look, reading"


def test_too_visual(spark):
    df = spark.createDataFrame(
        [
            ("coco/a.jpg", ["bright day"]),
            ("coco/a.jpg", ["mediocre"]),
            ("ocr_vqa/a.jpg", ["fine"]),
            ("OCR/a.jpg", ["fine"]),
            ("coco/a.jpg", ["COLOR"]),
            ("coco/a.jpg", ["colo", "r"]),
            ("coco/a.jpg", ["tick\right"]),
            ("coco/a.jpg", ["fine"]),
        ],
        "p string, c array<string>",
    )
    got = [r[0] for r in df.select(text.too_visual(F.col("p"), F.col("c"))).collect()]
    assert got == [True, True, True, False, True, False, True, False]


def test_expand_and_place(one):
    assert one(lambda F: text.expand_items(F.lit(f"Read {fv.ITEM_SLOT}."), "<d>", F.lit(3))) == "Read <d><d><d>."
    seen = {one(lambda F, k=k: text.place_tokens(F.lit(k), F.lit("q"), "<i>", F.lit(2))) for k in map(str, range(20))}
    assert seen == {"<i><i> q", "q <i><i>"}


def test_prompt_block(one):
    lines = one(lambda F: text.caption_lines(F.array(F.lit("x"), F.lit("y")), "numbered"))
    assert lines == "Image 1 - x\nImage 2 - y"
    got = one(lambda F: text.build_prompt(fv.SPEECH_PROMPT, F.lit('Caption: "{hi}"'), F.lit("Ask.")))
    assert got == fv.SPEECH_PROMPT.format(captions='Caption: "{hi}"', question="Ask.").strip()
    got = one(lambda F: text.build_prompt(fv.CAPTION_PROMPT, F.lit("t")))
    assert got == fv.CAPTION_PROMPT.format(captions="t")


def test_parse_json_fields(spark):
    values = [
        '{"question":"a","answer":"b"}',
        '{"question":"a"}',
        '{"question":"a","answer":null}',
        '{"question":"a","answer":"b"',
        '{"question":"a","ans',
        "",
        "[1]",
        '{"answer":"b","more":1,"question":"a"}',
    ]
    got = column(spark, lambda c: text.parse_json_fields(c, "question", "answer"), values)
    assert [tuple(g) if g else None for g in got] == [("a", "b")] + [None] * 6 + [("a", "b")]
    # a caption that is complete inside a cut-off object is not accepted
    assert column(spark, lambda c: text.parse_json_fields(c, "caption"), ['{"caption":"a"', '{"caption":"a"}'])[0] is None


def test_join_path_equals_posix(spark):
    rels = ["a/b", "/abs/x", "", "a//b", "a/"]
    for root in ("/data", "/data/", "rel", ""):
        assert column(spark, lambda c: media.join_path(root, c), rels) == [posixpath.join(root, r) for r in rels]


def test_dup_second_segment(spark):
    def brute(path):
        parts = path.split("/")
        if len(parts) < 2:
            return None
        return posixpath.join(*parts[:2], *parts[1:])

    values = ["a/b/c", "a/b", "a", "", "/a/b", "a//b", "a/b/", "/", "//", "a/b/c/d/e.jpg"]
    # an absolute later segment cannot occur, segments hold no slash
    assert column(spark, media.dup_second_segment, values) == [brute(v) for v in values]


def test_extension_equals_splitext(spark):
    values = ["a.wav", "x/.wav", "x/..wav", "..a.wav", "a.PNG", "a.png?x=1", "a.b/c", "a.b/c.jpg", "", ".", "a.", "a.jpeg", "b/a.tar.gz", "a.wav\n"]
    assert column(spark, media.file_extension, values) == [os.path.splitext(v)[1] for v in values]
    assert column(spark, media.extension_kind, ["a.PNG", "a.png?x=1", "a.wav", "a.jpeg", "some words"]) == [
        "text", "text", "audio", "vision", "text",
    ]


def test_clip_seconds(spark):
    values = ["01:02:03.500", "02:03", "9:01:02:03", "x:y:z", "0:0:1e1", "0:0:1d", " 1:2:3 ", "::", None]
    assert column(spark, media.clip_seconds, values) == [3723.5, None, 3723.0, None, 10.0, None, 3723.0, None, None]


def test_video_url(spark):
    assert column(spark, lambda c: media.video_url(c, drop=2), ["v_abc"]) == ["https://www.youtube.com/watch?v=abc"]


def test_square_pad_box(one):
    assert tuple(one(lambda F: media.square_pad_box(F.lit(10), F.lit(6)))) == (10, 0, 2)
    assert tuple(one(lambda F: media.square_pad_box(F.lit(5), F.lit(10)))) == (10, 2, 0)
    assert tuple(one(lambda F: media.square_pad_box(F.lit(7), F.lit(7)))) == (7, 0, 0)


def test_frame_indices_equal_numpy(spark):
    import numpy as np

    df = spark.range(60).select((F.col("id") + 5).alias("n"), F.col("id").cast("string").alias("k"))
    rows = df.select("n", "k", media.frame_indices(F.col("k"), 8, 1, F.col("n")).alias("f")).collect()
    for r in rows:
        if r["n"] <= 8:
            assert r["f"] is None
            continue
        end = 8 + int(hashlib.md5(f"frames:{r['k']}".encode()).hexdigest()[:8], 16) % (r["n"] - 8)
        want = np.clip(np.linspace(end - 8, end, num=8), end - 8, end - 1).astype(np.int64)
        assert r["f"] == list(want)


def test_to_mono(one):
    got = one(lambda F: vectors.to_mono(vectors.as_frames(F.col("v"), 2)), v=("array<double>", [1.0, 3.0, 5.0, 6.0]))
    assert got == [2.0, 5.5]


ITEM = "array array<double>, sampling_rate bigint, dataset string, idx bigint, path string, url string, text string"


@pytest.mark.parametrize(
    "fields, audio, image, video",
    [
        (dict(array=[0.0], sampling_rate=8, path="x"), "array", "error", "error"),
        (dict(array=[0.0]), "error", "error", "error"),
        (dict(dataset="d", idx=3, path="x"), "dataset_ref", "error", "error"),
        (dict(path="https://a/b.wav"), "path_http", "error", "error"),
        (dict(path="b.wav"), "path_local", "error", "error"),
        (dict(url="https://www.youtube.com/watch?v=1"), "error", "error", "hosted"),
        (dict(url=""), "error", "error", "error"),
        (dict(text="http://a/b.png"), "text_http", "http", "local"),
        (dict(text="b.png"), "text_local", "local", "local"),
        (dict(text="https://www.youtube.com/watch?v=1"), "text_http", "http", "hosted"),
    ],
)
def test_item_kinds(spark, fields, audio, image, video):
    names = [part.split()[0] for part in ITEM.split(", ")]
    df = spark.createDataFrame([tuple(fields.get(n) for n in names)], ITEM).select(F.struct(*names).alias("item"))
    row = df.select(
        media.audio_source(F.col("item")), media.image_source(F.col("item"), F.lit(True)), media.video_source(F.col("item"))
    ).first()
    assert tuple(row) == (audio, image, video)
