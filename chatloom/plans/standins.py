"""The test tables in the role of the builders' inputs.

The given text holds no placeholders, markers or trigger words, so they are added by rules on the row ids (FIXTURES.md).
Every rule only decides what a row looks like; no row is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import media
from chatloom.operators.messages import assemble_messages, qa_pairs
from chatloom.operators.ranking import hash_positions
from chatloom.session import stage
from chatloom.sources.files import read_table

MEDIA_ROOT = "/media"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def plain_chats(spark: SparkSession, sf: str) -> DataFrame:
    """``conv_id, messages``."""
    turns = table(spark, sf, "conversations")
    return assemble_messages(turns, "conv_id", "turn", F.col("role"), F.col("text"))


def chats(spark: SparkSession, sf: str) -> DataFrame:
    """``conv_id, images, documents, messages`` with placeholders.

    The first user turn gets conv_id % 4 images in front and, for every third chat, a document behind; assistant
    turns of every eleventh chat get a stray image. The item lists are one short where conv_id % 10 = 6 and one long
    where it is 7.
    """
    plain = plain_chats(spark, sf)
    conv = F.col("conv_id")
    first_user = F.array_position(F.transform("messages", lambda m: m["role"]), F.lit("user")) - 1

    def inject(m: Column, i: Column) -> Column:
        asked = F.concat(
            F.repeat(F.lit("<image>"), (conv % 4).cast("int")),
            m["content"],
            F.when(conv % 3 == 0, " <document>").otherwise(""),
        )
        stray = F.concat(m["content"], F.lit(" <image>"))
        content = (
            F.when(i == first_user, asked)
            .when((m["role"] == "assistant") & (conv % 11 == 0), stray)
            .otherwise(m["content"])
        )
        return F.struct(m["role"].alias("role"), content.alias("content"))

    n_images = (
        conv % 4
        - F.when((conv % 10 == 6) & (conv % 4 > 0), 1).otherwise(0)
        + F.when(conv % 10 == 7, 1).otherwise(0)
    ).cast("int")
    slots = F.transform(F.array_repeat(F.lit(0), n_images), lambda _, i: F.concat_ws("-", F.lit("img"), conv, i))
    return plain.select(
        "conv_id",
        slots.alias("images"),
        F.when(conv % 3 == 0, F.array(F.concat(F.lit("doc-"), conv))).otherwise(F.array().cast("array<string>")).alias("documents"),
        F.transform("messages", inject).alias("messages"),
    )


def chat_turns(spark: SparkSession, sf: str) -> DataFrame:
    """``conv_id, turn, role, text``: the turns of ``chats`` with the same placeholders, chats not put together."""
    turns = table(spark, sf, "conversations")
    conv = F.col("conv_id")
    first = turns.filter(F.col("role") == "user").groupBy("conv_id").agg(F.min("turn").alias("first_user"))
    asked = F.concat(F.repeat(F.lit("<image>"), (conv % 4).cast("int")), F.col("text"), F.when(conv % 3 == 0, " <document>").otherwise(""))
    stray = (F.col("role") == "assistant") & (conv % 11 == 0)
    text = (
        F.when(F.col("turn") == F.col("first_user"), asked)
        .when(stray, F.concat(F.col("text"), F.lit(" <image>")))
        .otherwise(F.col("text"))
    )
    return turns.join(first, "conv_id", "left").select("conv_id", "turn", "role", text.alias("text"))


def image_path(id_: Column) -> Column:
    """Relative path, absolute path, single segment, unwanted source, or none."""
    name = F.concat(id_.cast("string"), F.lit(".jpg"))
    return (
        F.when(id_ % 9 == 0, F.lit(None).cast("string"))
        .when(id_ % 8 == 0, F.concat(F.lit("ocr_vqa/images/"), name))
        .when(id_ % 13 == 0, F.concat(F.lit("/coco/train2017/"), name))
        .when(id_ % 17 == 0, name)
        .otherwise(F.concat(F.lit("coco/train2017/"), name))
    )


def loaded_words(id_: Column) -> Column:
    """Words that the rewording and the exclusion look for."""
    return F.concat(
        F.when(id_ % 3 == 0, "see the image, look at the visible photo, ").otherwise(""),
        F.when(id_ % 5 == 0, "bright ").otherwise(""),
    )


def dialog_turns(spark: SparkSession, sf: str) -> DataFrame:
    """``conv_id, turn, from, value``: speakers under their other names, first message with an image."""
    turns = table(spark, sf, "conversations")
    speaker = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    value = F.concat(
        F.when(F.col("turn") == 0, "<image>\n").otherwise(""),
        F.when(F.col("role") == "user", loaded_words(F.col("conv_id"))).otherwise(""),
        F.col("text"),
    )
    return turns.select("conv_id", "turn", speaker.alias("from"), value.alias("value"))


def dialogs(spark: SparkSession, sf: str) -> DataFrame:
    """``id, image, conversations``."""
    turns = dialog_turns(spark, sf)
    packed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "from", "value"))).alias("_t"))
    return packed.select(
        F.col("conv_id").cast("string").alias("id"),
        image_path(F.col("conv_id")).alias("image"),
        F.transform("_t", lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"),
    )


def media_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Existing files: those of the ids that the labels table covers, in both folder layouts."""
    image = image_path(F.col("doc_id"))
    paths = F.array(media.join_path(MEDIA_ROOT, image), media.join_path(MEDIA_ROOT, media.dup_second_segment(image)))
    listed = table(spark, sf, "labels").select(F.explode(paths).alias("path"))
    return listed.filter(F.col("path").isNotNull())


def papers(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, instruction, input, output``: documents inside the four frames, as plain input, or without any."""
    d = table(spark, sf, "documents")
    kind, t = F.col("doc_id") % 6, F.col("text")
    ask = F.concat(F.lit("Question: What about "), F.col("source"), F.lit("?"))
    instruction = (
        F.when(
            kind == 0,
            F.concat(
                F.lit("Below is a paper. Memorize the paper and answer my question after the paper.\n The paper begins. \n "),
                t, F.lit(" \n Now the paper ends. \n"), ask,
            ),
        )
        .when(
            kind == 1,
            F.concat(
                F.lit("Below is a paper. Memorize the material and answer my question after the paper.\n"),
                t, F.lit("\n Now the material ends. "), ask,
            ),
        )
        .when(
            kind == 2,
            F.concat(
                F.lit("There are two papers. Memorize them and answer my question after the paper.\n The first paper begins. \n "),
                t, F.lit(" Now the second paper ends."), ask,
            ),
        )
        .when(
            kind == 3,
            F.concat(
                F.lit("Below is some paragraphs in the book, "), F.col("lang"),
                F.lit(". Memorize the content and answer my question after the book.\n"),
                t, F.lit(" \n Now the material ends."), ask,
            ),
        )
        .when(kind == 4, F.concat(F.lit("Question: Sum up "), F.col("source")))
        .otherwise(t)
    )
    return d.select(
        F.col("doc_id").alias("row_id"),
        instruction.alias("instruction"),
        F.when(kind == 4, t).when(kind == 5, F.lit("")).alias("input"),
        F.concat(F.lit("Answer: "), F.col("lang"), F.lit(" "), F.col("n_chars").cast("string")).alias("output"),
    )


def long_texts(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, text``: documents inside the search-result frame, the question frame, or none."""
    d = table(spark, sf, "documents")
    kind, t = F.col("doc_id") % 3, F.col("text")
    ask = F.concat(F.lit("What about "), F.col("source"), F.lit("?"))
    framed = (
        F.when(
            kind == 0,
            F.concat(
                F.lit("Write a high-quality answer for the given question using only the provided search results (some of which might be irrelevant).\n"),
                t, F.lit("\nQuestion: "), ask, F.lit("\nAnswer: "), F.col("lang"), F.lit("\nLong Answer: "), F.col("source"), F.lit(" .\n"),
            ),
        )
        .when(kind == 1, F.concat(t, F.lit("\nQ: "), ask, F.lit(" \nA:  "), F.col("lang"), F.lit(" .")))
        .otherwise(t)
    )
    return d.select(F.col("doc_id").alias("row_id"), framed.alias("text"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``pair, question, answer``: a user turn and the assistant turn after it, numbered from 0 in hash order."""
    turns = table(spark, sf, "conversations")
    found = qa_pairs(turns, "conv_id", "turn", "role", "text")
    return hash_positions(found, ["conv_id", "turn"], "pairs", "pair").select("pair", "question", "answer")


def broken_json(payload: Column, n: Column) -> Column:
    """Every sixth text cut in half."""
    return F.when(n % 6 == 0, F.substring(payload, F.lit(1), (F.length(payload) / 2).cast("int"))).otherwise(payload)


def shards_for(rows: int) -> tuple[int, int]:
    """Shards and quota so that about ``rows`` draws are accepted in all."""
    shards = max(4, rows // 100_000)
    return shards, -(-rows // shards)


def answers(spark: SparkSession, sf: str) -> Callable[[DataFrame], DataFrame]:
    """A model's part: ``shard, attempt, response`` for whatever attempts it is handed, some of it cut off or incomplete."""
    qa = stage(pairs(spark, sf), "pairs")
    n = qa.count()

    def respond(requests: DataFrame) -> DataFrame:
        calls = requests.select("shard", "attempt", ((F.col("shard") * 7919 + F.col("attempt")) % n).alias("pair"))
        whole = F.to_json(F.struct("question", "answer"))
        partial = F.to_json(F.struct("question"))
        payload = F.when(F.col("attempt") % 7 == 0, partial).otherwise(whole)
        return calls.join(qa, "pair").select("shard", "attempt", broken_json(payload, F.col("attempt")).alias("response"))

    return respond


def sounds(spark: SparkSession, sf: str) -> DataFrame:
    """``idx, url, tags``."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("idx"),
        F.concat(F.lit("https://audio.example.com/"), F.col("p_partkey").cast("string"), F.lit(".mp3")).alias("url"),
        F.concat_ws(", ", "p_name", "p_type").alias("tags"),
    )


def captions(spark: SparkSession, sf: str) -> Callable[[DataFrame], DataFrame]:
    """``idx, response``: a caption for each request, some of it cut off or missing."""
    qa = stage(pairs(spark, sf), "pairs")
    n = qa.count()

    def respond(requests: DataFrame) -> DataFrame:
        calls = requests.select("idx", (F.col("idx") % n).alias("pair"))
        whole = F.to_json(F.struct(F.col("answer").alias("caption")))
        partial = F.to_json(F.struct(F.col("answer").alias("title")))
        payload = F.when(F.col("idx") % 7 == 0, partial).otherwise(whole)
        return calls.join(qa, "pair").select("idx", broken_json(payload, F.col("idx")).alias("response"))

    return respond


def clips(spark: SparkSession, sf: str) -> DataFrame:
    """``clip_id, video_id, start, end, caption``: times of day with some malformed ones."""
    e = table(spark, sf, "events")
    n = F.col("event_id")
    stamp = F.date_format("ts", "HH:mm:ss.SSS")
    start = (
        F.when(n % 17 == 0, F.substring(stamp, 4, 9))
        .when(n % 19 == 0, F.lit("x:y:z"))
        .when(n % 23 == 0, F.concat(F.lit("0:"), stamp))
        .otherwise(stamp)
    )
    return e.select(
        n.alias("clip_id"),
        F.concat(F.lit("vid"), n.cast("string")).alias("video_id"),
        start.alias("start"),
        stamp.alias("end"),
        F.concat_ws(" ", "event_type", "props").alias("caption"),
    )


def rollout(spark: SparkSession, sf: str) -> DataFrame:
    """``round, frame, action``: event types as action codes, one of them unknown."""
    codes = {"view": 0, "click": 1, "purchase": 2, "signup": 3}
    action = F.lit(4)
    for kind, code in codes.items():
        action = F.when(F.col("event_type") == kind, F.lit(code)).otherwise(action)
    return table(spark, sf, "events").select(
        F.col("user_id").alias("round"), F.col("event_id").alias("frame"), action.alias("action")
    )


def images(spark: SparkSession, sf: str) -> DataFrame:
    """``idx, image, caption``."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("idx"),
        F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image"),
        F.col("text").alias("caption"),
    )


def speech(spark: SparkSession, sf: str) -> DataFrame:
    """``idx, text``."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("idx"), "text")


def token_vectors(vocab: DataFrame, embeddings: DataFrame, n_vectors: int) -> DataFrame:
    """``token_id, freq`` and the columns of ``embeddings``: each vocabulary entry takes a row of that table, or of its index."""
    met = vocab.withColumn("vec_id", F.col("token_id") % n_vectors).join(embeddings, "vec_id")
    return met.select("token_id", "freq", *embeddings.columns)


def abbreviated(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, text``: documents in which some words have an abbreviation in front."""
    text = F.replace(F.replace("text", F.lit(" in "), F.lit(" e.g. in ")), F.lit(" die "), F.lit(" bzw. die "))
    return table(spark, sf, "documents").select("doc_id", F.replace(text, F.lit(" la "), F.lit(" No. 5 la ")).alias("text"))
