"""The dataset builders, each a composition of the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom import fixed_values as fv
from chatloom.functions import hashing, media, text
from chatloom.operators import chunking, extraction, joins, messages, ranking, sampling
from chatloom.operators.answers import ask_once
from chatloom.session import stage, staging_path
from chatloom.sources.files import write_cache_jsonl


def _dialog_rows(dialogs: DataFrame, item_column: str, converted: Column) -> DataFrame:
    """``id, <items>, messages`` with one item per row; ``file`` holds the item's path."""
    return dialogs.select(
        F.col("id").cast("string").alias("id"), F.array("file").alias(item_column), converted.alias("messages")
    )


def _checked(rows: DataFrame, on_error: str) -> DataFrame:
    """An unknown speaker aborts the build, or drops the row with ``on_error='reject'``."""
    bad = F.when(messages.unknown_role(F.col("messages")), F.lit("unknown role"))
    return messages.split_rejects(rows, bad, on_error)[0]


def _require_image(dialogs: DataFrame, on_error: str) -> DataFrame:
    missing = F.when(F.col("image").isNull(), F.lit("no image"))
    return messages.split_rejects(dialogs, missing, on_error)[0]


def _fixed_path(dialogs: DataFrame, root: str, on_error: str) -> DataFrame:
    """Path below ``root`` with its second segment doubled; a path of one segment is a row error."""
    doubled = dialogs.withColumn("_fixed", media.dup_second_segment(F.col("image")))
    short = F.when(F.col("_fixed").isNull(), F.lit("path of one segment"))
    good = messages.split_rejects(doubled, short, on_error)[0]
    return good.withColumn("file", media.join_path(root, F.col("_fixed"))).drop("_fixed")


def image_pretrain(dialogs: DataFrame, root: str, manifest: DataFrame, on_error: str = "fail") -> DataFrame:
    """Every dialogue must name an image; those whose file is missing are skipped."""
    located = _require_image(dialogs, on_error).withColumn("file", media.join_path(root, F.col("image")))
    existing = joins.keep_existing(located, manifest, "file")
    return _checked(_dialog_rows(existing, "images", messages.convert_dialog(F.col("conversations"))), on_error)


def image_finetune(dialogs: DataFrame, root: str, manifest: DataFrame, on_error: str = "fail") -> DataFrame:
    """Dialogues without an image are skipped silently, whatever ``on_error`` says."""
    located = _fixed_path(_require_image(dialogs, "reject"), root, on_error)
    existing = joins.keep_existing(located, manifest, "file")
    return _checked(_dialog_rows(existing, "images", messages.convert_dialog(F.col("conversations"))), on_error)


def _reworded() -> Column:
    """Messages in the wording of the row's kind; the kind is drawn per row, not per message."""
    kind = text.wording_kind(F.col("id"))
    return F.transform(
        "conversations",
        lambda t: F.struct(text.normalize_role(t["from"]).alias("role"), text.reword(t["value"], kind).alias("content")),
    )


def crossmodal_pretrain(dialogs: DataFrame, root: str, manifest: DataFrame, on_error: str = "fail") -> DataFrame:
    located = _require_image(dialogs, on_error).withColumn("file", media.join_path(root, F.col("image")))
    existing = joins.keep_existing(located, manifest, "file")
    return _checked(_dialog_rows(existing, "imagebinds", _reworded()), on_error)


def crossmodal_finetune(dialogs: DataFrame, root: str, manifest: DataFrame, on_error: str = "fail") -> DataFrame:
    """The cheap word and path tests come before the join with the file list."""
    named = _require_image(dialogs, "reject")
    plain = named.filter(~text.too_visual(F.col("image"), F.transform("conversations", lambda t: t["value"])))
    existing = joins.keep_existing(_fixed_path(plain, root, on_error), manifest, "file")
    return _checked(_dialog_rows(existing, "imagebinds", _reworded()), on_error)


def document_pretrain(
    articles: DataFrame,
    max_examples: int = 1_000_000,
    max_chunks: int = fv.PRETRAIN_MAX_CHUNKS,
    window: int = fv.DOCUMENT_WINDOW,
    key: str = "title",
) -> DataFrame:
    """``(title, text)`` articles of few enough chunks: repeat the document. ``key`` must be unique."""

    def build(rows: DataFrame) -> DataFrame:
        return chunking.cap_chunks(chunking.chunk_documents(rows, "text", window), max_chunks)

    source = articles.select(*dict.fromkeys([key, "title", "text"]))
    accepted = sampling.accept_until(source, [key], build, max_examples, "doc_pretrain")
    question = text.expand_items(
        text.pick_template(F.col(key), fv.DOCUMENT_PHRASES, "document"), "<document>", F.size("chunks")
    )
    return accepted.select(
        F.col("title").cast("string").alias("id"),
        chunking.chunk_texts(F.col("chunks")).alias("documents"),
        text.qa_messages(question, F.col("text")).alias("messages"),
    )


def document_finetune(
    papers: DataFrame, long_texts: DataFrame, max_chunks: int = fv.FINETUNE_MAX_CHUNKS, window: int = fv.DOCUMENT_WINDOW
) -> DataFrame:
    """Both long-document sources through their extractors, chunked, capped and shuffled.

    The inputs carry a unique ``row_id``; ids are made from the text, so copies of a text share theirs and could
    neither be ordered nor spread by it.
    """

    def accepted(extracted: DataFrame, source: int) -> DataFrame:
        good = extracted.filter(F.col("reject_reason").isNull())
        return good.select(F.lit(source).alias("source"), "row_id", "id", "document", "prompt", "answer")

    both = accepted(extraction.extract_paper_qa(papers, "instruction", "input", "output"), 0).unionByName(
        accepted(extraction.extract_long_qa(long_texts, "text"), 1)
    )
    chunked = chunking.cap_chunks(chunking.chunk_documents(both, "document", window), max_chunks)
    rows = chunked.select(
        "source",
        "row_id",
        "id",
        chunking.chunk_texts(F.col("chunks")).alias("documents"),
        text.qa_messages(text.expand_items(F.col("prompt"), "<document>", F.size("chunks")), F.col("answer")).alias("messages"),
    )
    # extraction and chunking are costly and the shuffle reads its input twice
    return sampling.shuffle_dataset(stage(rows, "document_finetune"), ["source", "row_id"], "42")


def speech_reference(idx: Column, dataset: dict[str, str] = fv.SPEECH_DATASET) -> Column:
    args = F.struct(*[F.lit(v).alias(k) for k, v in dataset.items()])
    return F.struct(args.alias("dataset_args"), idx.cast("bigint").alias("idx"))


def speech_text(df: DataFrame) -> Column:
    """The ``text`` column if the dataset has one, else ``sentence``."""
    return F.col("text") if "text" in df.columns else F.col("sentence")


def speech_pretrain(speech: DataFrame, max_examples: int = 200_000) -> DataFrame:
    """``(idx, text or sentence)`` rows: transcribe. Items refer to rows of the speech dataset."""
    chosen = sampling.accept_until(speech, ["idx"], lambda rows: rows, max_examples, "speech_pretrain")
    question = text.pick_template(F.col("idx"), fv.SPEECH_PHRASES, "speech")
    return chosen.select(
        text.stable_id("speech-", F.col("idx").cast("string")).alias("id"),
        F.array(speech_reference(F.col("idx"))).alias("speech_audios"),
        text.qa_messages(question, speech_text(speech)).alias("messages"),
    )


# Answers of a model: a table keyed like the requests, or a function that is handed the requests, prompts included, and
# returns such a table. ``response`` is JSON text.
Responses = DataFrame | Callable[[DataFrame], DataFrame]


def parsed_answers(answers: DataFrame, *fields: str) -> DataFrame:
    """The rows whose ``response`` parses, with its ``fields`` in its place."""
    parsed = answers.withColumn("_qa", text.parse_json_fields(F.col("response"), *fields)).filter(F.col("_qa").isNotNull())
    return parsed.select(*[c for c in answers.columns if c != "response"], *[F.col(f"_qa.{f}").alias(f) for f in fields])


def generated_answers(requests: DataFrame, responses: Responses, keys: Sequence[str], *fields: str) -> DataFrame:
    """The requests whose answer parses, with the answer's ``fields``; ``prompt`` is dropped."""
    table = responses(requests) if callable(responses) else responses
    return parsed_answers(requests.drop("prompt").join(table.select(*keys, "response"), list(keys)), *fields)


def _draw_answers(
    spark: SparkSession,
    rows: int,
    responses: Responses,
    shards: int,
    quota: int,
    salt: str,
    ask: Callable[[DataFrame], DataFrame],
    log: str | None = None,
) -> DataFrame:
    """(shard, slot, attempt, idx, question, answer): attempts accepted by their answers alone, cut to the quota.

    ``ask`` turns attempts into requests. Prompts are made for a responding function only, which is asked for an attempt
    once: its answers go to ``log`` (a folder of this run if none is given) and are taken from there. A table needs no log.
    """
    log = log or staging_path(spark, "answers")

    def build(attempts: DataFrame) -> DataFrame:
        if not callable(responses):
            return generated_answers(attempts, responses, ["shard", "attempt"], "question", "answer")
        given = ask_once(attempts, lambda todo: responses(ask(todo)), log, salt, sampling.drawn_row(salt, rows))
        return parsed_answers(given, "question", "answer")

    return sampling.draw_with_retry(spark, rows, build, shards, quota, salt, start=1 if callable(responses) else 2)


def _rows(source: DataFrame) -> int:
    """How many rows can be drawn; their ``idx`` must count 0, 1, ..., or drawn rows would be missing."""
    if not ranking.is_dense(source, "idx"):
        raise ValueError("idx must count from 0 without gaps; ranking.dense_index makes it so")
    return source.count()


def _attempt_key() -> Column:
    return hashing.key_text(F.col("shard"), F.col("attempt"))


def _question(phrases: list[str], key: Column) -> Column:
    return text.pick_template(key, phrases, "question")


def speech_prompts(attempts: DataFrame, speech: DataFrame) -> DataFrame:
    """``attempts`` (shard, attempt, idx) with the prompt a model is asked for the drawn row."""
    rows = speech.select("idx", speech_text(speech).alias("_caption"))
    lines = text.caption_lines(F.array("_caption"), "caption")
    prompt = text.build_prompt(fv.SPEECH_PROMPT, lines, _question(fv.SPEECH_QUESTIONS, _attempt_key()))
    return attempts.join(rows, "idx").select(*attempts.columns, prompt.alias("prompt"))


def sound_prompts(attempts: DataFrame, sounds: DataFrame) -> DataFrame:
    lines = text.caption_lines(F.array("tags"), "plain")
    prompt = text.build_prompt(fv.SOUND_PROMPT, lines, _question(fv.SOUND_QUESTIONS, _attempt_key()))
    return attempts.join(sounds.select("idx", "tags"), "idx").select(*attempts.columns, prompt.alias("prompt"))


def caption_prompts(sounds: DataFrame) -> DataFrame:
    """``idx, prompt`` of every sound."""
    return sounds.select("idx", text.build_prompt(fv.CAPTION_PROMPT, text.caption_lines(F.array("tags"), "tags")).alias("prompt"))


def image_prompts(attempts: DataFrame, images: DataFrame, rows: int, max_images: int = 6) -> DataFrame:
    """The prompt of each attempt over the captions of the images that its example draws."""
    examples = attempts.withColumn("example", _attempt_key())
    draws = sampling.draw_k_rows(examples, "example", rows, max_images, "images")
    prompts = multi_image_prompts(joins.gather_rows(draws, images, "example", ["caption"]), "example", "caption")
    return examples.join(prompts, "example").select(*attempts.columns, "prompt")


def speech_generated(
    spark: SparkSession, speech: DataFrame, responses: Responses, shards: int, quota: int, cache: str | None = None, log: str | None = None
) -> DataFrame:
    """Question/answer rows over randomly drawn speech rows; responses are keyed by (shard, attempt).

    A responding function is asked for an attempt once. With ``log``, a folder that outlives the run, that holds for all
    runs together: a build that was stopped half-way goes on from the answers it has. With ``cache`` the finished rows are
    also appended to that folder as JSON lines.
    """

    def ask(attempts: DataFrame) -> DataFrame:
        return speech_prompts(attempts, speech)

    accepted = _draw_answers(spark, _rows(speech), responses, shards, quota, "speech_draw", ask, log)
    question = text.place_tokens(_attempt_key(), F.col("question"), "<speech>", F.lit(1))
    rows = accepted.select(
        "shard",
        "slot",
        text.stable_id("speech-", _attempt_key()).alias("id"),
        F.array(speech_reference(F.col("idx"))).alias("speech_audios"),
        text.qa_messages(question, F.col("answer")).alias("messages"),
    )
    return cached(rows, cache)


def sound_generated(
    spark: SparkSession, sounds: DataFrame, responses: Responses, shards: int, quota: int, cache: str | None = None, log: str | None = None
) -> DataFrame:
    """Question/answer rows over randomly drawn ``(idx, url, tags)`` sounds, fetched after the quota is met."""

    def ask(attempts: DataFrame) -> DataFrame:
        return sound_prompts(attempts, sounds)

    accepted = _draw_answers(spark, _rows(sounds), responses, shards, quota, "sound_draw", ask, log)
    question = text.place_tokens(_attempt_key(), F.col("question"), "<sound>", F.lit(1))
    rows = accepted.join(sounds.select("idx", "url"), "idx").select(
        "shard",
        "slot",
        text.stable_id("sound-", _attempt_key()).alias("id"),
        F.array("url").alias("sounds"),
        text.qa_messages(question, F.col("answer")).alias("messages"),
    )
    return cached(rows, cache)


def sound_captions(sounds: DataFrame, responses: Responses, cache: str | None = None, log: str | None = None) -> DataFrame:
    """Every sound once, in random order; a failed caption is dropped, not drawn again. ``log`` as for drawn rows."""
    if callable(responses) and log is not None:
        each = sounds.select(F.lit(0).cast("bigint").alias("shard"), F.col("idx").alias("attempt"), "idx")

        def ask(todo: DataFrame) -> DataFrame:
            given = responses(caption_prompts(sounds.join(todo.select("idx"), "idx", "left_semi")))
            return given.select(F.lit(0).cast("bigint").alias("shard"), F.col("idx").alias("attempt"), "response")

        parsed = parsed_answers(ask_once(each, ask, log, "sound_captions", F.col("attempt")).select("idx", "response"), "caption")
    else:
        requests = caption_prompts(sounds) if callable(responses) else sounds.select("idx")
        parsed = generated_answers(requests, responses, ["idx"], "caption")
    question = text.pick_template(F.col("idx"), fv.SOUND_PHRASES, "sound")
    rows = parsed.join(sounds.select("idx", "url"), "idx").select(
        "idx",
        text.stable_id("sound-", F.col("idx").cast("string")).alias("id"),
        F.array("url").alias("sounds"),
        text.qa_messages(question, F.col("caption")).alias("messages"),
    )
    # joined and parsed once: the shuffle reads its input twice
    return sampling.shuffle_dataset(cached(stage(rows, "sound_captions"), cache), ["idx"], "sound_captions")


def multi_image_generated(
    spark: SparkSession,
    images: DataFrame,
    responses: Responses,
    shards: int,
    quota: int,
    max_images: int = 6,
    cache: str | None = None,
    log: str | None = None,
) -> DataFrame:
    """Question/answer rows over 1..max_images distinct images ``(idx, image, caption)`` in drawn order.

    The images of an attempt depend on its number alone, so they are fetched for accepted attempts only.
    """
    n = _rows(images)

    def ask(attempts: DataFrame) -> DataFrame:
        return image_prompts(attempts, images, n, max_images)

    accepted = _draw_answers(spark, n, responses, shards, quota, "image_draw", ask, log).withColumn("example", _attempt_key())
    draws = sampling.draw_k_rows(accepted, "example", n, max_images, "images")
    rows = accepted.join(joins.gather_rows(draws, images, "example", ["image"]), "example")
    question = text.place_tokens(F.col("example"), F.col("question"), "<image>", F.size("image"))
    rows = rows.select(
        "shard",
        "slot",
        text.stable_id("images-", F.col("example")).alias("id"),
        F.col("image").alias("images"),
        text.qa_messages(question, F.col("answer")).alias("messages"),
    )
    return cached(rows, cache)


def multi_image_prompts(gathered: DataFrame, example: str, captions: str) -> DataFrame:
    """The prompt of each example, from the captions of its images in drawn order."""
    prompt = text.build_prompt(
        fv.MULTI_IMAGE_PROMPT,
        text.caption_lines(F.col(captions), "numbered"),
        text.pick_template(F.col(example), fv.MULTI_IMAGE_QUESTIONS, "question"),
    )
    return gathered.select(example, prompt.alias("prompt"))


def cached(rows: DataFrame, folder: str | None) -> DataFrame:
    """Append the rows to the cache, if there is one, and go on with what was staged for it."""
    if folder is None:
        return rows
    rows = stage(rows, "generated")
    write_cache_jsonl(rows, folder)
    return rows


def video_pretrain(clips: DataFrame, max_examples: int = 500_000) -> DataFrame:
    """``(clip_id, video_id, start, end, caption)`` clips: sample first, then drop clips whose times do not parse."""
    sampled = sampling.sample_at_most(clips, ["clip_id"], max_examples, "video_sample")
    timed = sampled.withColumn("_start", media.clip_seconds(F.col("start"))).withColumn(
        "_end", media.clip_seconds(F.col("end"))
    )
    reason = F.when(F.col("video_id").isNull(), "no video id").when(
        F.col("_start").isNull() | F.col("_end").isNull(), "bad clip time"
    )
    good, _ = messages.split_rejects(timed, reason)
    video = F.struct(
        media.video_url(F.col("video_id")).alias("url"),
        F.col("_start").alias("start_time"),
        F.col("_end").alias("end_time"),
    )
    return good.select(
        text.stable_id("video-", F.col("clip_id").cast("string")).alias("id"),
        F.array(video).alias("videos"),
        text.qa_messages(text.pick_template(F.col("clip_id"), fv.VIDEO_PHRASES, "video"), F.col("caption")).alias("messages"),
    )


def video_finetune(pairs: DataFrame) -> DataFrame:
    """``(row_id, video_id, q, a)`` rows; the first two characters of the id (``v_``) are no part of the address."""
    good, _ = messages.split_rejects(pairs, F.when(F.col("video_id").isNull(), "no video id"))
    return good.select(
        text.stable_id("video-qa-", F.col("row_id").cast("string")).alias("id"),
        F.array(media.video_url(F.col("video_id"), drop=2)).alias("videos"),
        text.qa_messages(F.col("q"), F.col("a")).alias("messages"),
    )


def action_label(code: Column) -> Column:
    out = F.lit("")
    for number, label in fv.LANDER_ACTION_LABELS.items():
        out = F.when(code == number, F.lit(label)).otherwise(out)
    return out


def label_to_action(label: Column) -> Column:
    """Exact labels only; anything else is action 0."""
    out = F.lit(0)
    for number, name in fv.LANDER_ACTION_LABELS.items():
        out = F.when(label == name, F.lit(number)).otherwise(out)
    return out


def policy_rows(rollout: DataFrame, image_root: str, rate: float = 0.01) -> DataFrame:
    """``(round, frame, action)`` steps of recorded games: a sample of them as examples of the next action."""
    keyed = rollout.withColumn("id", F.concat_ws("_", F.col("round").cast("string"), F.col("frame").cast("string")))
    sampled = sampling.sample_rate(keyed, F.col("id"), rate, "policy")
    options = F.array_join(hashing.shuffled(F.col("id"), "options", fv.LANDER_OPTIONS), ", ")
    return sampled.select(
        "id",
        F.array(media.join_path(image_root, F.concat("id", F.lit(".jpg")))).alias("images"),
        text.qa_messages(F.concat(F.lit(fv.LANDER_QUESTION), options), action_label(F.col("action"))).alias("messages"),
    )
