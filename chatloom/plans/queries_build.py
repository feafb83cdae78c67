"""Queries over the complete dataset builders, sampling and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom import fixed_values as fv
from chatloom.functions import text
from chatloom.operators import chunking, joins, merging, sampling
from chatloom.plans import builders, standins
from chatloom.plans.queries_encode import sql_chunks
from chatloom.plans.queries_text import (
    SQL_CLIPS,
    SQL_IMAGE,
    SQL_LOADED,
    SQL_LONG_QA,
    SQL_PAIRS,
    SQL_PAPER_QA,
    flat_messages,
    sql_dup,
    sql_join_path,
    sql_place,
    sql_prompt,
    sql_reword,
    sql_seconds,
)
from chatloom.plans.registry import query, quote, sql_hash, sql_hash60, sql_order, sql_pick
from chatloom.session import stage

N_SAMPLE = 200


def flat(rows: DataFrame, items: str, *extra: str) -> DataFrame:
    return rows.select(*extra, "id", F.array_join(items, "|").alias(items), flat_messages(F.col("messages")).alias("messages"))


# ---- dialogues -------------------------------------------------------------------------------------------------

SQL_DIALOGS = f"""speech_turns AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' END AS role,
    CASE WHEN turn = 0 THEN '<image>' || chr(10) ELSE '' END || CASE WHEN role = 'user' THEN {SQL_LOADED.format(id='conv_id')} ELSE '' END || text AS value FROM conversations),
dialogs AS (SELECT conv_id, {SQL_IMAGE.format(id='conv_id')} AS image, bool_and(role IS NOT NULL) AS known,
    string_agg(role || ': ' || value, chr(10) ORDER BY turn) AS plain,
    string_agg(role || ': ' || {sql_reword('value', f"({sql_hash('conv_id', 'wording')} % 3)")}, chr(10) ORDER BY turn) AS reworded,
    bool_or(regexp_matches(lower(replace(replace(value, chr(13), '\\r'), chr(12), '\\x0c')), 'region|ocr|color|right|left')) AS loaded
  FROM speech_turns GROUP BY conv_id),
kept AS (SELECT * FROM dialogs WHERE image IS NOT NULL AND known AND conv_id IN (SELECT doc_id FROM labels))"""


@query(
    "build_image_pretrain",
    f"""WITH {SQL_DIALOGS} SELECT conv_id::VARCHAR AS id, {sql_join_path('/media', 'image')} AS images, plain AS messages FROM kept""",
)
def build_image_pretrain(spark: SparkSession, sf: str) -> DataFrame:
    rows = builders.image_pretrain(standins.dialogs(spark, sf), standins.MEDIA_ROOT, standins.media_manifest(spark, sf), "reject")
    return flat(rows, "images")


@query(
    "build_image_finetune",
    f"""WITH {SQL_DIALOGS} SELECT conv_id::VARCHAR AS id, '/media/' || {sql_dup('image')} AS images, plain AS messages
FROM kept WHERE {sql_dup('image')} IS NOT NULL""",
)
def build_image_finetune(spark: SparkSession, sf: str) -> DataFrame:
    rows = builders.image_finetune(standins.dialogs(spark, sf), standins.MEDIA_ROOT, standins.media_manifest(spark, sf), "reject")
    return flat(rows, "images")


@query(
    "build_crossmodal_pretrain",
    f"""WITH {SQL_DIALOGS} SELECT conv_id::VARCHAR AS id, {sql_join_path('/media', 'image')} AS imagebinds, reworded AS messages FROM kept""",
)
def build_crossmodal_pretrain(spark: SparkSession, sf: str) -> DataFrame:
    rows = builders.crossmodal_pretrain(
        standins.dialogs(spark, sf), standins.MEDIA_ROOT, standins.media_manifest(spark, sf), "reject"
    )
    return flat(rows, "imagebinds")


@query(
    "build_crossmodal_finetune",
    f"""WITH {SQL_DIALOGS} SELECT conv_id::VARCHAR AS id, '/media/' || {sql_dup('image')} AS imagebinds, reworded AS messages
FROM kept WHERE {sql_dup('image')} IS NOT NULL AND NOT contains(image, 'ocr') AND NOT loaded""",
)
def build_crossmodal_finetune(spark: SparkSession, sf: str) -> DataFrame:
    rows = builders.crossmodal_finetune(
        standins.dialogs(spark, sf), standins.MEDIA_ROOT, standins.media_manifest(spark, sf), "reject"
    )
    return flat(rows, "imagebinds")


# ---- documents ---------------------------------------------------------------------------------------------------


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    return standins.table(spark, sf, "documents").select(
        F.concat_ws(" ", F.lit("article"), F.col("doc_id")).alias("title"), "text"
    )


@query(
    "doc_pretrain_rows",
    f"""WITH RECURSIVE articles AS (SELECT 'article ' || doc_id AS title, text FROM documents),
{sql_chunks('articles', 'title', 'text', 512)},
c AS (SELECT k AS title, count(*) AS n, string_agg(text, '|' ORDER BY c) AS documents FROM chunks GROUP BY k HAVING count(*) <= 4)
SELECT title AS id, documents, 'user: ' || replace({sql_pick('title', 'document', fv.DOCUMENT_PHRASES)}, {quote(fv.ITEM_SLOT)}, repeat('<document>', n::INT))
  || chr(10) || 'assistant: ' || text AS messages
FROM c JOIN articles USING (title) ORDER BY {sql_order('title', 'doc_pretrain')} LIMIT 1000000""",
)
def doc_pretrain_rows(spark: SparkSession, sf: str) -> DataFrame:
    return flat(builders.document_pretrain(_articles(spark, sf)), "documents")


@query(
    "accept_until",
    f"""WITH RECURSIVE {sql_chunks('documents', 'doc_id', 'text', 512)},
c AS (SELECT k AS doc_id, count(*) AS n_chunks FROM chunks GROUP BY k HAVING count(*) <= 4)
SELECT doc_id, n_chunks, row_number() OVER (ORDER BY {sql_order('doc_id', 'accept')}) - 1 AS position
FROM c QUALIFY position < {N_SAMPLE}""",
)
def accept_until(spark: SparkSession, sf: str) -> DataFrame:
    """The first accepted documents in random order: a sampling operator, so it stops at n."""

    def build(rows: DataFrame) -> DataFrame:
        return chunking.cap_chunks(chunking.chunk_documents(rows, "text"), fv.PRETRAIN_MAX_CHUNKS).select(
            "doc_id", F.size("chunks").cast("bigint").alias("n_chunks")
        )

    docs = standins.table(spark, sf, "documents").select("doc_id", "text")
    return sampling.accept_until(docs, ["doc_id"], build, N_SAMPLE)


@query(
    "doc_finetune_rows",
    f"""WITH RECURSIVE {SQL_PAPER_QA}, {SQL_LONG_QA},
both_ AS (SELECT 0 AS source, row_id, id, document, prompt, answer FROM paper_qa WHERE reject_reason IS NULL
  UNION ALL SELECT 1, row_id, id, document, prompt, answer FROM long_qa WHERE reject_reason IS NULL),
keyed AS (SELECT *, source || ':' || row_id AS key FROM both_),
{sql_chunks('keyed', 'key', 'document', 512)},
c AS (SELECT k AS key, count(*) AS n, string_agg(text, '|' ORDER BY c) AS documents FROM chunks GROUP BY k HAVING count(*) <= 256)
SELECT row_number() OVER (ORDER BY {sql_order('key', '42')}) - 1 AS position, id, documents,
  'user: ' || replace(prompt, {quote(fv.ITEM_SLOT)}, repeat('<document>', n::INT)) || chr(10) || 'assistant: ' || answer AS messages
FROM c JOIN keyed USING (key)""",
)
def doc_finetune_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = builders.document_finetune(standins.papers(spark, sf), standins.long_texts(spark, sf))
    return flat(rows, "documents", "position")


# ---- speech and sound ------------------------------------------------------------------------------------------------

_REF = "mozilla-foundation/common_voice_15_0/en/train#"


def _ref_text(item):
    args = item["dataset_args"]
    return F.concat(F.concat_ws("/", args["path"], args["name"], args["split"]), F.lit("#"), item["idx"].cast("string"))


@query(
    "speech_pretrain_rows",
    f"""SELECT 'speech-' || sha256(item_id::VARCHAR) AS id, '{_REF}' || item_id AS speech_audios,
  'user: ' || {sql_pick('item_id', 'speech', fv.SPEECH_PHRASES)} || chr(10) || 'assistant: ' || text AS messages
FROM benchmark ORDER BY {sql_order('item_id', 'speech_pretrain')} LIMIT 200000""",
)
def speech_pretrain_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = builders.speech_pretrain(standins.speech(spark, sf))
    return flat(rows.withColumn("speech_audios", F.transform("speech_audios", _ref_text)), "speech_audios")


def sql_draws(table: str, salt: str) -> str:
    """Attempts of every shard with the row they draw and the answer they get; the first ``quota`` good ones count."""
    return f"""size_ AS (SELECT count(*) AS n FROM {table}),
plan AS (SELECT n, greatest(4, n // 100000) AS shards, -(-n // greatest(4, n // 100000)) AS quota FROM size_),
quotas AS (SELECT n, shards, CASE WHEN n % shards = 0 THEN n // shards ELSE n // shards + 1 END AS quota FROM plan),
attempts AS (SELECT s.shard, a.attempt, q.n, q.quota FROM quotas q, LATERAL (SELECT unnest(range(q.shards)) AS shard) s, LATERAL (SELECT unnest(range(q.quota * 8)) AS attempt) a),
{SQL_PAIRS}, n_pairs AS (SELECT count(*) AS np FROM pairs),
answers AS (SELECT t.shard, t.attempt, t.quota, {sql_hash60("t.shard || ':' || t.attempt", salt)} % t.n AS idx, p.question, p.answer
  FROM attempts t, n_pairs JOIN pairs p ON p.pair = (t.shard * 7919 + t.attempt) % np
  WHERE t.attempt % 6 <> 0 AND t.attempt % 7 <> 0),
drawn AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY attempt) - 1 AS slot FROM answers QUALIFY slot < quota)"""


@query(
    "speech_generated_rows",
    f"""WITH {sql_draws('benchmark', 'speech_draw')}
SELECT shard, slot, 'speech-' || sha256(shard || ':' || attempt) AS id, '{_REF}' || idx AS speech_audios,
  'user: ' || {sql_place("shard || ':' || attempt", 'question', '<speech>', '1')} || chr(10) || 'assistant: ' || answer AS messages FROM drawn""",
)
def speech_generated_rows(spark: SparkSession, sf: str) -> DataFrame:
    source = standins.speech(spark, sf)
    shards, quota = standins.shards_for(source.count())
    responses = standins.answers(spark, sf)
    rows = builders.speech_generated(spark, source, responses, shards, quota)
    return flat(rows.withColumn("speech_audios", F.transform("speech_audios", _ref_text)), "speech_audios", "shard", "slot")


def first_attempts(spark: SparkSession, rows: int, salt: str) -> DataFrame:
    """``shard, attempt, idx``: as many attempts as there are rows."""
    shards, quota = standins.shards_for(rows)
    return sampling.attempts(spark, rows, shards, 0, quota, salt)


def sql_first_attempts(table: str, salt: str) -> str:
    return f"""size_ AS (SELECT count(*) AS n FROM {table}),
quotas AS (SELECT n, greatest(4, n // 100000) AS shards FROM size_),
attempts AS (SELECT s.shard, a.attempt, {sql_hash60("s.shard || ':' || a.attempt", salt)} % n AS idx FROM quotas q,
  LATERAL (SELECT unnest(range(q.shards)) AS shard) s, LATERAL (SELECT unnest(range((q.n + q.shards - 1) // q.shards)) AS attempt) a)"""


_ATTEMPT = "shard || ':' || attempt"


@query(
    "speech_prompts",
    f"""WITH {sql_first_attempts('benchmark', 'speech_draw')}
SELECT shard, attempt, idx, {sql_prompt(fv.SPEECH_PROMPT, "'Caption: " + '"' + "' || text || '" + '"' + "'", sql_pick(_ATTEMPT, 'question', fv.SPEECH_QUESTIONS))} AS prompt
FROM attempts JOIN benchmark ON item_id = idx""",
)
def speech_prompts(spark: SparkSession, sf: str) -> DataFrame:
    source = standins.speech(spark, sf)
    return builders.speech_prompts(first_attempts(spark, source.count(), "speech_draw"), source)


@query(
    "sound_prompts",
    f"""WITH {sql_first_attempts('part', 'sound_draw')}
SELECT shard, attempt, idx, {sql_prompt(fv.SOUND_PROMPT, "p_name || ', ' || p_type", sql_pick(_ATTEMPT, 'question', fv.SOUND_QUESTIONS))} AS prompt
FROM attempts JOIN part ON p_partkey = idx""",
)
def sound_prompts(spark: SparkSession, sf: str) -> DataFrame:
    source = standins.sounds(spark, sf)
    return builders.sound_prompts(first_attempts(spark, source.count(), "sound_draw"), source)


@query(
    "caption_prompts",
    f"""SELECT p_partkey AS idx, {sql_prompt(fv.CAPTION_PROMPT, "'Tags: " + '"' + "' || p_name || ', ' || p_type || '" + '"' + "'")} AS prompt FROM part""",
)
def caption_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return builders.caption_prompts(standins.sounds(spark, sf))


@query(
    "sound_generated_rows",
    f"""WITH {sql_draws('part', 'sound_draw')}
SELECT shard, slot, 'sound-' || sha256(shard || ':' || attempt) AS id, 'https://audio.example.com/' || idx || '.mp3' AS sounds,
  'user: ' || {sql_place("shard || ':' || attempt", 'question', '<sound>', '1')} || chr(10) || 'assistant: ' || answer AS messages FROM drawn""",
)
def sound_generated_rows(spark: SparkSession, sf: str) -> DataFrame:
    source = standins.sounds(spark, sf)
    shards, quota = standins.shards_for(source.count())
    responses = standins.answers(spark, sf)
    return flat(builders.sound_generated(spark, source, responses, shards, quota), "sounds", "shard", "slot")


@query(
    "sound_generated_captions",
    f"""WITH {SQL_PAIRS}, n_pairs AS (SELECT count(*) AS np FROM pairs),
ok AS (SELECT p_partkey AS idx, answer FROM part, n_pairs JOIN pairs ON pair = p_partkey % np WHERE p_partkey % 6 <> 0 AND p_partkey % 7 <> 0)
SELECT row_number() OVER (ORDER BY {sql_order('idx', 'sound_captions')}) - 1 AS position, 'sound-' || sha256(idx::VARCHAR) AS id,
  'https://audio.example.com/' || idx || '.mp3' AS sounds,
  'user: ' || {sql_pick('idx', 'sound', fv.SOUND_PHRASES)} || chr(10) || 'assistant: ' || answer AS messages FROM ok""",
)
def sound_generated_captions(spark: SparkSession, sf: str) -> DataFrame:
    rows = builders.sound_captions(standins.sounds(spark, sf), standins.captions(spark, sf))
    return flat(rows, "sounds", "position")


def sql_k_rows(examples: str, key: str, n: str, max_k: int) -> str:
    """k distinct rows per example: each draw counts the rows that were not drawn before."""
    return f"""steps AS (
  SELECT {key} AS example, {n} AS n, 0 AS i, []::BIGINT[] AS drawn, {sql_hash(key, 'images.count')} % {max_k} + 1 AS k FROM {examples}
  UNION ALL
  SELECT example, n, i + 1, list_append(drawn, list_reduce(
    list_concat([{sql_hash60("example || ':' || i", 'images.row')} % (n - i)], list_sort(drawn)),
    lambda v, taken: CASE WHEN taken <= v THEN v + 1 ELSE v END)), k FROM steps WHERE i < k),
chosen AS (SELECT example, unnest(drawn) AS idx, unnest(range(k)) AS slot FROM steps WHERE i = k)"""


@query(
    "draw_k_rows",
    f"""WITH RECURSIVE ex AS (SELECT item_id AS example_id, (SELECT count(*) FROM documents) AS n FROM benchmark),
{sql_k_rows('ex', 'example_id', 'n', 6)}
SELECT example AS item_id, slot, idx FROM chosen""",
)
def draw_k_rows(spark: SparkSession, sf: str) -> DataFrame:
    examples = standins.table(spark, sf, "benchmark").select("item_id")
    rows = standins.table(spark, sf, "documents").count()
    return sampling.draw_k_rows(examples, "item_id", rows, 6, "images")


@query(
    "draw_with_retry",
    f"""WITH {sql_draws('documents', 'draw')} SELECT shard, slot, attempt, idx FROM drawn""",
)
def draw_with_retry(spark: SparkSession, sf: str) -> DataFrame:
    rows = standins.table(spark, sf, "documents").count()
    shards, quota = standins.shards_for(rows)
    responses = standins.answers(spark, sf)

    def build(attempts: DataFrame) -> DataFrame:
        return builders.generated_answers(attempts, responses, ["shard", "attempt"], "answer").select("shard", "attempt", "idx")

    return sampling.draw_with_retry(spark, rows, build, shards, quota, start=2).select("shard", "slot", "attempt", "idx")


@query(
    "multi_image_generated",
    f"""WITH RECURSIVE {sql_draws('documents', 'image_draw')},
ex AS (SELECT shard, slot AS place, attempt, shard || ':' || attempt AS ex_key, question, answer, n FROM drawn, size_),
{sql_k_rows('ex', 'ex_key', 'n', 6)},
g AS (SELECT example, count(*) AS k, string_agg('images/' || idx || '.jpg', '|' ORDER BY slot) AS images FROM chosen GROUP BY example)
SELECT ex.shard, ex.place AS slot, 'images-' || sha256(ex.ex_key) AS id, g.images,
  'user: ' || {sql_place('ex.ex_key', 'ex.question', '<image>', 'g.k')} || chr(10) || 'assistant: ' || ex.answer AS messages
FROM ex JOIN g ON g.example = ex.ex_key""",
)
def multi_image_generated(spark: SparkSession, sf: str) -> DataFrame:
    source = standins.images(spark, sf)
    shards, quota = standins.shards_for(source.count())
    responses = standins.answers(spark, sf)
    return flat(builders.multi_image_generated(spark, source, responses, shards, quota), "images", "shard", "slot")


@query(
    "multi_image_prompts",
    f"""WITH RECURSIVE ex AS (SELECT item_id AS example_id, (SELECT count(*) FROM documents) AS n FROM benchmark),
{sql_k_rows('ex', 'example_id', 'n', 6)},
l AS (SELECT example, string_agg('Image ' || (slot + 1) || ' - ' || text, chr(10) ORDER BY slot) AS lines FROM chosen JOIN documents ON doc_id = idx GROUP BY example)
SELECT example AS item_id, {quote(fv.MULTI_IMAGE_PROMPT.split('{captions}')[0])} || lines
  || {quote(fv.MULTI_IMAGE_PROMPT.split('{captions}')[1].split('{question}')[0])}
  || {sql_pick('example', 'question', fv.MULTI_IMAGE_QUESTIONS)} || {quote(fv.MULTI_IMAGE_PROMPT.split('{question}')[1])} AS prompt FROM l""",
)
def multi_image_prompts(spark: SparkSession, sf: str) -> DataFrame:
    draws = draw_k_rows(spark, sf)
    gathered = joins.gather_rows(draws, standins.images(spark, sf), "item_id", ["caption"])
    return builders.multi_image_prompts(gathered, "item_id", "caption")


# ---- video -----------------------------------------------------------------------------------------------------------------

@query(
    "build_video_pretrain",
    f"""WITH {SQL_CLIPS}, s AS (SELECT * FROM clips ORDER BY {sql_order('clip_id', 'video_sample')} LIMIT 500000),
t AS (SELECT *, {sql_seconds('"start"')} AS a, {sql_seconds('"end"')} AS b FROM s)
SELECT 'video-' || sha256(clip_id::VARCHAR) AS id, 'https://www.youtube.com/watch?v=' || video_id AS url, round(a, 6) AS start_time, round(b, 6) AS end_time,
  'user: ' || {sql_pick('clip_id', 'video', fv.VIDEO_PHRASES)} || chr(10) || 'assistant: ' || caption AS messages
FROM t WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def build_video_pretrain(spark: SparkSession, sf: str) -> DataFrame:
    rows = builders.video_pretrain(standins.clips(spark, sf))
    video = F.element_at("videos", 1)
    return rows.select(
        "id",
        video["url"].alias("url"),
        F.round(video["start_time"], 6).alias("start_time"),
        F.round(video["end_time"], 6).alias("end_time"),
        flat_messages(F.col("messages")).alias("messages"),
    )


@query(
    "build_video_finetune",
    f"""WITH {SQL_PAIRS} SELECT 'video-qa-' || sha256(pair::VARCHAR) AS id, 'https://www.youtube.com/watch?v=' || conv_id || 'x' || turn AS videos,
  'user: ' || question || chr(10) || 'assistant: ' || answer AS messages FROM pairs""",
)
def build_video_finetune(spark: SparkSession, sf: str) -> DataFrame:
    from chatloom.operators.messages import qa_pairs
    from chatloom.operators.ranking import hash_positions

    turns = standins.table(spark, sf, "conversations")
    numbered = hash_positions(qa_pairs(turns, "conv_id", "turn", "role", "text"), ["conv_id", "turn"], "pairs", "row_id")
    video = F.concat(F.lit("v_"), F.col("conv_id").cast("string"), F.lit("x"), F.col("turn").cast("string"))
    return flat(
        builders.video_finetune(numbered.select("row_id", video.alias("video_id"), F.col("question").alias("q"), F.col("answer").alias("a"))),
        "videos",
    )


# ---- references, shuffle, sample, merge ----------------------------------------------------------------------------------------


@query(
    "resolve_refs",
    """WITH r AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'benchmark' ELSE 'documents' END AS dataset, user_id AS idx FROM events),
s AS (SELECT 'documents' AS dataset, doc_id AS idx, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark)
SELECT r.event_id, r.dataset, r.idx, s.text, CASE WHEN s.idx IS NULL THEN 'dangling' ELSE 'resolved' END AS verdict
FROM r LEFT JOIN s USING (dataset, idx)""",
)
def resolve_refs(spark: SparkSession, sf: str) -> DataFrame:
    """References in the form in which builders store them, resolved and dangling ones by one join."""
    name = F.when(F.col("event_id") % 4 == 0, "benchmark").otherwise("documents")
    args = F.struct(name.alias("path"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("split"))
    refs = standins.table(spark, sf, "events").select("event_id", F.struct(args.alias("dataset_args"), F.col("user_id").alias("idx")).alias("ref"))
    sources = {
        "documents": standins.table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "text"),
        "benchmark": standins.speech(spark, sf),
    }
    found = joins.attach_refs(refs, sources, reference="ref")
    return found.select("event_id", F.col("ref.dataset_args.path").alias("dataset"), F.col("ref.idx").alias("idx"), "text", "verdict")


@query(
    "shuffle_dataset",
    f"SELECT doc_id, row_number() OVER (ORDER BY {sql_order('doc_id', 'shuffle')}) - 1 AS position, text FROM documents",
)
def shuffle_dataset(spark: SparkSession, sf: str) -> DataFrame:
    docs = standins.table(spark, sf, "documents").select("doc_id", "text")
    return sampling.shuffle_dataset(docs, ["doc_id"]).select("doc_id", "position", "text")


@query(
    "sample_at_most",
    f"SELECT doc_id, text FROM documents ORDER BY {sql_order('doc_id', 'sample')} LIMIT {N_SAMPLE}",
)
def sample_at_most(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: exactly N_SAMPLE rows."""
    return sampling.sample_at_most(standins.table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], N_SAMPLE)


@query(
    "merge_datasets",
    f"""WITH first_user AS (SELECT conv_id, min(turn) AS fu FROM conversations WHERE role = 'user' GROUP BY conv_id), {SQL_PAIRS},
a AS (SELECT 0 AS dataset_no, 'doc-' || doc_id AS id, 'file-' || doc_id AS documents, NULL AS images, 'user: Transcribe <document>' || chr(10) || 'assistant: ' || text AS messages FROM documents),
b AS (SELECT 1, 'pair-' || pair, NULL, 'img-' || pair, 'user: ' || question || chr(10) || 'assistant: ' || answer FROM pairs),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT 2, id, documents, images, messages FROM a)
SELECT row_number() OVER (ORDER BY {sql_order("dataset_no || ':' || id", 'merge')}) - 1 AS position, dataset_no::BIGINT AS dataset_no, id,
  coalesce(documents, '') AS documents, coalesce(images, '') AS images, messages FROM u""",
)
def merge_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Document rows, conversation rows, and the document rows once more: copies are kept."""
    docs = standins.table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.array(F.concat(F.lit("file-"), F.col("doc_id").cast("string"))).alias("documents"),
        text.qa_messages(F.lit("Transcribe <document>"), F.col("text")).alias("messages"),
    )
    talks = stage(standins.pairs(spark, sf), "pairs").select(
        F.concat(F.lit("pair-"), F.col("pair").cast("string")).alias("id"),
        F.array(F.concat(F.lit("img-"), F.col("pair").cast("string"))).alias("images"),
        text.qa_messages(F.col("question"), F.col("answer")).alias("messages"),
    )
    merged = merging.merge_datasets([docs, talks, docs])
    none = F.array().cast("array<string>")
    return merged.select(
        "position",
        "dataset_no",
        "id",
        F.array_join(F.coalesce("documents", none), "|").alias("documents"),
        F.array_join(F.coalesce("images", none), "|").alias("images"),
        flat_messages(F.col("messages")).alias("messages"),
    )
