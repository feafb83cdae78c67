"""Queries over projections, filters and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom import fixed_values as fv
from chatloom.functions import hashing, media, text
from chatloom.operators import extraction, messages, sentences
from chatloom.operators.joins import keep_existing
from chatloom.plans import builders, standins
from chatloom.plans.registry import query, quote, sql_hash, sql_list, sql_order, sql_pick, sql_strip
from chatloom.session import stage

# ---- shared SQL ----------------------------------------------------------------------------------------------

SQL_LOADED = """(CASE WHEN {id} % 3 = 0 THEN 'see the image, look at the visible photo, ' ELSE '' END
  || CASE WHEN {id} % 5 = 0 THEN 'bright ' ELSE '' END)"""

SQL_IMAGE = """CASE WHEN {id} % 9 = 0 THEN NULL
  WHEN {id} % 8 = 0 THEN 'ocr_vqa/images/' || {id} || '.jpg'
  WHEN {id} % 13 = 0 THEN '/coco/train2017/' || {id} || '.jpg'
  WHEN {id} % 17 = 0 THEN {id} || '.jpg'
  ELSE 'coco/train2017/' || {id} || '.jpg' END"""


def sql_join_path(root: str, rel: str) -> str:
    return f"CASE WHEN {rel} LIKE '/%' THEN {rel} ELSE '{root}/' || {rel} END"


def sql_dup(path: str) -> str:
    p = f"string_split({path}, '/')"
    return (
        f"CASE WHEN len({p}) >= 2 THEN array_to_string(list_filter({p}[1:2] || {p}[2:], lambda s: s <> ''), '/')"
        f" || CASE WHEN {path} LIKE '%/' AND len(list_filter({p}, lambda s: s <> '')) > 0 THEN '/' ELSE '' END END"
    )


def sql_reword(content: str, kind: str) -> str:
    out = f"replace({content}, '<image>', {quote(fv.ITEM_SLOT)})"
    for word, targets in fv.WORDING.items():
        out = f"replace({out}, {quote(word)}, ({sql_list(targets)})[{kind} + 1])"
    return f"replace({out}, {quote(fv.ITEM_SLOT)}, '<imagebind>')"


SQL_PAIRS = f"""pairs AS (
  SELECT row_number() OVER (ORDER BY {sql_order("a.conv_id || ':' || a.turn", "pairs")}) - 1 AS pair,
         a.conv_id, a.turn, a.text AS question, b.text AS answer
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""

# ---- roles and messages ----------------------------------------------------------------------------------------


@query(
    "role_normalize",
    """SELECT conv_id, turn,
  CASE WHEN role IN ('user', 'assistant') THEN role END AS role,
  CASE WHEN role IN ('user', 'assistant') THEN 'ok' ELSE 'unknown role' END AS verdict
FROM conversations""",
)
def role_normalize(spark: SparkSession, sf: str) -> DataFrame:
    turns = standins.dialog_turns(spark, sf)
    role = text.normalize_role(F.col("from"))
    return turns.select(
        "conv_id", "turn", role.alias("role"), F.when(role.isNull(), "unknown role").otherwise("ok").alias("verdict")
    )


@query(
    "messages_assemble",
    """SELECT conv_id, count(*) AS n_messages,
  string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages
FROM conversations GROUP BY conv_id""",
)
def messages_assemble(spark: SparkSession, sf: str) -> DataFrame:
    chats = standins.plain_chats(spark, sf)
    return chats.select(
        "conv_id",
        F.size("messages").cast("bigint").alias("n_messages"),
        flat_messages(F.col("messages")).alias("messages"),
    )


def flat_messages(col):
    return F.array_join(F.transform(col, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


@query(
    "qa_rows",
    f"""WITH {SQL_PAIRS}
SELECT conv_id, turn, 'clip-' || conv_id AS item,
  'user: ' || question || chr(10) || 'assistant: ' || answer AS messages FROM pairs""",
)
def qa_rows(spark: SparkSession, sf: str) -> DataFrame:
    turns = standins.table(spark, sf, "conversations")
    found = messages.qa_pairs(turns, "conv_id", "turn", "role", "text")
    return found.select(
        "conv_id",
        "turn",
        F.concat(F.lit("clip-"), F.col("conv_id").cast("string")).alias("item"),
        flat_messages(text.qa_messages(F.col("question"), F.col("answer"))).alias("messages"),
    )


# ---- paths -------------------------------------------------------------------------------------------------------


@query(
    "require_field",
    f"""SELECT doc_id, {SQL_IMAGE.format(id='doc_id')} AS image FROM documents
WHERE ({SQL_IMAGE.format(id='doc_id')}) IS NOT NULL""",
)
def require_field(spark: SparkSession, sf: str) -> DataFrame:
    docs = standins.table(spark, sf, "documents").select("doc_id", standins.image_path(F.col("doc_id")).alias("image"))
    return messages.split_rejects(docs, F.when(F.col("image").isNull(), "no image"))[0]


_URL_PATH = r"^https?://([^#?]*)"


@query(
    "path_join_fix",
    f"""WITH p AS (
  SELECT page_id AS id, 'page' AS origin, regexp_extract(url, '{_URL_PATH}', 1) AS rel FROM pages
  UNION ALL SELECT doc_id, 'image', {SQL_IMAGE.format(id='doc_id')} FROM documents)
SELECT id, origin, {sql_join_path('/data/media', 'rel')} AS joined, {sql_dup('rel')} AS doubled,
  CASE WHEN {sql_dup('rel')} IS NULL THEN 'reject' ELSE 'ok' END AS verdict FROM p""",
)
def path_join_fix(spark: SparkSession, sf: str) -> DataFrame:
    pages = standins.table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.lit("page").alias("origin"), F.regexp_extract("url", _URL_PATH, 1).alias("rel")
    )
    docs = standins.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.lit("image").alias("origin"), standins.image_path(F.col("doc_id")).alias("rel")
    )
    doubled = media.dup_second_segment(F.col("rel"))
    return pages.unionByName(docs).select(
        "id",
        "origin",
        media.join_path("/data/media", F.col("rel")).alias("joined"),
        doubled.alias("doubled"),
        F.when(doubled.isNull(), "reject").otherwise("ok").alias("verdict"),
    )


@query(
    "keep_existing",
    f"""SELECT d.doc_id, {sql_join_path('/media', SQL_IMAGE.format(id='d.doc_id'))} AS file,
  CASE WHEN l.doc_id IS NOT NULL THEN 'kept' ELSE 'skipped' END AS verdict
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND ({SQL_IMAGE.format(id='d.doc_id')}) IS NOT NULL""",
)
def keep_existing_query(spark: SparkSession, sf: str) -> DataFrame:
    from chatloom.operators.joins import missing_files

    docs = standins.table(spark, sf, "documents").select(
        "doc_id", media.join_path(standins.MEDIA_ROOT, standins.image_path(F.col("doc_id"))).alias("file")
    )
    manifest = standins.media_manifest(spark, sf)
    kept = keep_existing(docs, manifest, "file").withColumn("verdict", F.lit("kept"))
    skipped = missing_files(docs, manifest, "file").withColumn("verdict", F.lit("skipped"))
    return kept.unionByName(skipped)


# ---- words -------------------------------------------------------------------------------------------------------


@query(
    "exclude_keywords",
    f"""WITH d AS (SELECT doc_id, coalesce({SQL_IMAGE.format(id='doc_id')}, '') AS path,
  {SQL_LOADED.format(id='doc_id')} || text AS content FROM documents)
SELECT doc_id, path FROM d WHERE NOT (contains(path, 'ocr')
  OR regexp_matches(lower(replace(replace(content, chr(13), '\\r'), chr(12), '\\x0c')), 'region|ocr|color|right|left'))""",
)
def exclude_keywords(spark: SparkSession, sf: str) -> DataFrame:
    docs = standins.table(spark, sf, "documents").select(
        "doc_id",
        F.coalesce(standins.image_path(F.col("doc_id")), F.lit("")).alias("path"),
        F.concat(standins.loaded_words(F.col("doc_id")), F.col("text")).alias("content"),
    )
    return docs.filter(~text.too_visual(F.col("path"), F.array("content"))).select("doc_id", "path")


@query(
    "vocab_rewrite",
    f"""WITH t AS (SELECT conv_id, turn, {sql_hash('conv_id', 'wording')} % 3 AS kind,
  CASE WHEN turn = 0 THEN '<image>' || chr(10) ELSE '' END
  || CASE WHEN role = 'user' THEN {SQL_LOADED.format(id='conv_id')} ELSE '' END || text AS content FROM conversations)
SELECT conv_id, turn, kind, {sql_reword('content', 'kind')} AS content FROM t""",
)
def vocab_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    turns = standins.dialog_turns(spark, sf).withColumn("kind", text.wording_kind(F.col("conv_id")))
    return turns.select("conv_id", "turn", "kind", text.reword(F.col("value"), F.col("kind")).alias("content"))


@query(
    "template_pick",
    f"""SELECT doc_id, {sql_pick('doc_id', 'document', fv.DOCUMENT_PHRASES)} AS document_phrase,
  {sql_pick('doc_id', 'speech', fv.SPEECH_PHRASES)} AS speech_phrase,
  {sql_pick('doc_id', 'video', fv.VIDEO_PHRASES)} AS video_phrase,
  {sql_pick('doc_id', 'sound', fv.SOUND_PHRASES)} AS sound_phrase FROM documents""",
)
def template_pick(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id")
    return standins.table(spark, sf, "documents").select(
        "doc_id",
        text.pick_template(key, fv.DOCUMENT_PHRASES, "document").alias("document_phrase"),
        text.pick_template(key, fv.SPEECH_PHRASES, "speech").alias("speech_phrase"),
        text.pick_template(key, fv.VIDEO_PHRASES, "video").alias("video_phrase"),
        text.pick_template(key, fv.SOUND_PHRASES, "sound").alias("sound_phrase"),
    )


def sql_place(key: str, question: str, token: str, n: str) -> str:
    tokens = f"repeat('{token}', ({n})::INT)"
    return (
        f"CASE WHEN {sql_hash(key, 'place')} % 2 = 0 THEN {tokens} || ' ' || {question}"
        f" ELSE {question} || ' ' || {tokens} END"
    )


@query(
    "token_placement",
    f"""WITH {SQL_PAIRS}
SELECT conv_id, turn, {sql_place("conv_id || ':' || turn", 'question', '<image>', 'turn % 6 + 1')} AS content FROM pairs""",
)
def token_placement(spark: SparkSession, sf: str) -> DataFrame:
    turns = standins.table(spark, sf, "conversations")
    found = messages.qa_pairs(turns, "conv_id", "turn", "role", "text")
    key = hashing.key_text(F.col("conv_id"), F.col("turn"))
    return found.select(
        "conv_id", "turn", text.place_tokens(key, F.col("question"), "<image>", F.col("turn") % 6 + 1).alias("content")
    )


# ---- clips and videos --------------------------------------------------------------------------------------------

SQL_CLIPS = """clips AS (
  SELECT event_id AS clip_id, 'vid' || event_id AS video_id,
    CASE WHEN event_id % 17 = 0 THEN substr(strftime(ts, '%H:%M:%S.%g'), 4, 9)
         WHEN event_id % 19 = 0 THEN 'x:y:z'
         WHEN event_id % 23 = 0 THEN '0:' || strftime(ts, '%H:%M:%S.%g')
         ELSE strftime(ts, '%H:%M:%S.%g') END AS "start",
    strftime(ts, '%H:%M:%S.%g') AS "end", event_type || ' ' || props AS caption
  FROM events)"""


def sql_seconds(stamp: str) -> str:
    p = f"string_split({stamp}, ':')"
    return (
        f"(TRY_CAST({p}[-1] AS DOUBLE) + TRY_CAST(list_extract({p}, -2) AS DOUBLE) * 60.0::DOUBLE"
        f" + TRY_CAST(list_extract({p}, -3) AS DOUBLE) * 60.0::DOUBLE * 60.0::DOUBLE)"
    )


@query(
    "clip_seconds",
    f"""WITH {SQL_CLIPS}
SELECT clip_id, round({sql_seconds('"start"')}, 6) AS start_time, round({sql_seconds('"end"')}, 6) AS end_time FROM clips""",
)
def clip_seconds(spark: SparkSession, sf: str) -> DataFrame:
    return standins.clips(spark, sf).select(
        "clip_id",
        F.round(media.clip_seconds(F.col("start")), 6).alias("start_time"),
        F.round(media.clip_seconds(F.col("end")), 6).alias("end_time"),
    )


@query(
    "bad_row_split",
    f"""WITH {SQL_CLIPS}, t AS (SELECT clip_id, "start", {sql_seconds('"start"')} AS s FROM clips)
SELECT clip_id, "start" AS stamp, CASE WHEN s IS NULL THEN 'rejects' ELSE 'accepted' END AS output,
  CASE WHEN s IS NULL THEN 'bad clip time' END AS reject_reason FROM t""",
)
def bad_row_split(spark: SparkSession, sf: str) -> DataFrame:
    timed = standins.clips(spark, sf).select("clip_id", F.col("start").alias("stamp"))
    reason = F.when(media.clip_seconds(F.col("stamp")).isNull(), "bad clip time")
    good, bad = messages.split_rejects(timed, reason)
    return good.select(
        "clip_id", "stamp", F.lit("accepted").alias("output"), F.lit(None).cast("string").alias("reject_reason")
    ).unionByName(bad.select("clip_id", "stamp", F.lit("rejects").alias("output"), "reject_reason"))


@query(
    "video_rows",
    """SELECT event_id, 'https://www.youtube.com/watch?v=vid' || event_id AS pretrain_url,
  'https://www.youtube.com/watch?v=' || substr('v_' || event_type || event_id, 3) AS finetune_url FROM events""",
)
def video_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    return standins.table(spark, sf, "events").select(
        "event_id",
        media.video_url(F.concat(F.lit("vid"), n)).alias("pretrain_url"),
        media.video_url(F.concat(F.lit("v_"), F.col("event_type"), n), drop=2).alias("finetune_url"),
    )


# ---- extraction ----------------------------------------------------------------------------------------------------

_ASK = "'Question: What about ' || source || '?'"
SQL_PAPERS = f"""papers AS (
  SELECT doc_id AS row_id, doc_id % 6 AS kind, text AS doc, lang, source,
    'Answer: ' || lang || ' ' || n_chars AS output,
    CASE doc_id % 6
      WHEN 0 THEN 'Below is a paper. Memorize the paper and answer my question after the paper.' || chr(10) || ' The paper begins. ' || chr(10) || ' ' || text || ' ' || chr(10) || ' Now the paper ends. ' || chr(10) || {_ASK}
      WHEN 1 THEN 'Below is a paper. Memorize the material and answer my question after the paper.' || chr(10) || text || chr(10) || ' Now the material ends. ' || {_ASK}
      WHEN 2 THEN 'There are two papers. Memorize them and answer my question after the paper.' || chr(10) || ' The first paper begins. ' || chr(10) || ' ' || text || ' Now the second paper ends.' || {_ASK}
      WHEN 3 THEN 'Below is some paragraphs in the book, ' || lang || '. Memorize the content and answer my question after the book.' || chr(10) || text || ' ' || chr(10) || ' Now the material ends.' || {_ASK}
      WHEN 4 THEN 'Question: Sum up ' || source
      ELSE text END AS instruction
  FROM documents)"""


def _sql_group(column: str, patterns: list[str], number: int, group: int) -> str:
    return rf"regexp_extract({column}, {quote(chr(92) + 'A' + patterns[number])}, {group})"


def _sql_matches(column: str, patterns: list[str], number: int) -> str:
    return rf"regexp_matches({column}, {quote(chr(92) + 'A' + patterns[number])})"


def _sql_prompt(column: str, patterns: list[str], template: str, number: int, strip: bool) -> str:
    import re

    out = []
    for i, piece in enumerate(re.split(r"\\(\d)", template)):
        if i % 2:
            group = _sql_group(column, patterns, number, int(piece))
            out.append(sql_strip(group) if strip else group)
        elif piece:
            out.append(quote(piece))
    return " || ".join(out)


def _sql_cases(column: str, patterns: list[str], values: list[str]) -> str:
    whens = " ".join(
        f"WHEN {_sql_matches(column, patterns, i)} THEN {v}" for i, v in enumerate(values)
    )
    return f"CASE {whens} END"


_P = fv.PAPER_PATTERNS
SQL_PAPER_QA = f"""{SQL_PAPERS}, paper_raw AS (
  SELECT row_id, 'longalpaca-' || sha256(instruction) AS id, kind, instruction, output,
    {_sql_cases('instruction', _P, [_sql_group('instruction', _P, i, g) for i, g in enumerate(fv.PAPER_DOCUMENT_GROUPS)])} AS d,
    {_sql_cases('instruction', _P, [_sql_prompt('instruction', _P, t, i, False) for i, t in enumerate(fv.PAPER_PROMPTS)])} AS p,
    CASE kind WHEN 4 THEN doc WHEN 5 THEN '' END AS input
  FROM papers), paper_qa AS (
  SELECT row_id, id,
    CASE WHEN d IS NULL AND input <> '' THEN input ELSE d END AS document,
    CASE WHEN d IS NULL AND input <> '' THEN instruction || ' {fv.ITEM_SLOT}' ELSE replace(p, 'Question: ', '') END AS prompt,
    replace(output, 'Answer: ', '') AS answer,
    CASE WHEN d IS NULL AND NOT coalesce(input <> '', false) THEN 'no document found' END AS reject_reason
  FROM paper_raw)"""

SQL_LONG_TEXTS = """long_texts AS (
  SELECT doc_id AS row_id,
    CASE doc_id % 3
      WHEN 0 THEN 'Write a high-quality answer for the given question using only the provided search results (some of which might be irrelevant).' || chr(10) || text || chr(10) || 'Question: What about ' || source || '?' || chr(10) || 'Answer: ' || lang || chr(10) || 'Long Answer: ' || source || ' .' || chr(10)
      WHEN 1 THEN text || chr(10) || 'Q: What about ' || source || '? ' || chr(10) || 'A:  ' || lang || ' .'
      ELSE text END AS text
  FROM documents)"""
_L = fv.LONG_TEXT_PATTERNS
SQL_LONG_QA = f"""{SQL_LONG_TEXTS}, long_raw AS (
  SELECT row_id, 'longdatacollection-' || sha256(text) AS id,
    {_sql_cases('text', _L, [sql_strip(_sql_group('text', _L, i, 1)) for i in range(2)])} AS document,
    {_sql_cases('text', _L, [_sql_prompt('text', _L, t, i, True) for i, t in enumerate(fv.LONG_TEXT_PROMPTS)])} AS prompt,
    replace({_sql_cases('text', _L, [sql_strip(_sql_group('text', _L, i, g)) for i, g in enumerate(fv.LONG_TEXT_ANSWER_GROUPS)])}, ' .', '.') AS answer
  FROM long_texts), long_qa AS (
  SELECT *, CASE WHEN coalesce(document, '') = '' OR coalesce(answer, '') = '' THEN 'no document found' END AS reject_reason
  FROM long_raw)"""


@query("paper_qa_extract", f"WITH {SQL_PAPER_QA} SELECT row_id, id, document, prompt, answer, reject_reason FROM paper_qa")
def paper_qa_extract(spark: SparkSession, sf: str) -> DataFrame:
    out = extraction.extract_paper_qa(standins.papers(spark, sf), "instruction", "input", "output")
    return out.select("row_id", "id", "document", "prompt", "answer", "reject_reason")


@query("long_qa_extract", f"WITH {SQL_LONG_QA} SELECT row_id, id, document, prompt, answer, reject_reason FROM long_qa")
def long_qa_extract(spark: SparkSession, sf: str) -> DataFrame:
    out = extraction.extract_long_qa(standins.long_texts(spark, sf), "text")
    return out.select("row_id", "id", "document", "prompt", "answer", "reject_reason")


# ---- prompts and answers -----------------------------------------------------------------------------------------


def sql_prompt(frame: str, lines: str, question: str | None = None) -> str:
    head, rest = frame.split("{captions}")
    if question is None:
        return f"{quote(head)} || {lines} || {quote(rest)}"
    middle, rest = rest.split("{question}")
    return f"{quote(head)} || {lines} || {quote(middle)} || {question} || {quote(rest)}"


@query(
    "generation_prompts",
    f"""SELECT doc_id AS id, 'multi_image' AS kind,
  {sql_prompt(fv.MULTI_IMAGE_PROMPT, "'Image 1 - ' || text || chr(10) || 'Image 2 - ' || lang", sql_pick('doc_id', 'question', fv.MULTI_IMAGE_QUESTIONS))} AS prompt FROM documents
UNION ALL SELECT item_id, 'speech',
  {sql_prompt(fv.SPEECH_PROMPT, "'Caption: " + '"' + "' || text || '" + '"' + "'", sql_pick('item_id', 'question', fv.SPEECH_QUESTIONS))} FROM benchmark
UNION ALL SELECT p_partkey, 'sound',
  {sql_prompt(fv.SOUND_PROMPT, "p_name || ', ' || p_type", sql_pick('p_partkey', 'question', fv.SOUND_QUESTIONS))} FROM part
UNION ALL SELECT p_partkey, 'caption',
  {sql_prompt(fv.CAPTION_PROMPT, "'Tags: " + '"' + "' || p_name || ', ' || p_type || '" + '"' + "'")} FROM part""",
)
def generation_prompts(spark: SparkSession, sf: str) -> DataFrame:
    def question(phrases: list[str]):
        return text.pick_template(F.col("id"), phrases, "question")

    docs = standins.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.array("text", "lang").alias("captions")
    )
    spoken = standins.speech(spark, sf).select(F.col("idx").alias("id"), F.array("text").alias("captions"))
    tagged = standins.sounds(spark, sf).select(F.col("idx").alias("id"), F.array("tags").alias("captions"))
    captions = F.col("captions")
    parts = [
        (docs, "multi_image", text.build_prompt(fv.MULTI_IMAGE_PROMPT, text.caption_lines(captions, "numbered"), question(fv.MULTI_IMAGE_QUESTIONS))),
        (spoken, "speech", text.build_prompt(fv.SPEECH_PROMPT, text.caption_lines(captions, "caption"), question(fv.SPEECH_QUESTIONS))),
        (tagged, "sound", text.build_prompt(fv.SOUND_PROMPT, text.caption_lines(captions, "plain"), question(fv.SOUND_QUESTIONS))),
        (tagged, "caption", text.build_prompt(fv.CAPTION_PROMPT, text.caption_lines(captions, "tags"))),
    ]
    out = None
    for frame, kind, prompt in parts:
        rows = frame.select("id", F.lit(kind).alias("kind"), prompt.alias("prompt"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "parse_generated",
    f"""WITH {SQL_PAIRS}, j AS (
  SELECT conv_id, turn, pair, CASE WHEN pair % 7 = 0 THEN json_object('question', question)
    ELSE json_object('question', question, 'answer', answer) END::VARCHAR AS whole FROM pairs),
  r AS (SELECT *, CASE WHEN pair % 6 = 0 THEN substr(whole, 1, (length(whole) // 2)::INT) ELSE whole END AS response FROM j),
  v AS (SELECT conv_id, turn, CASE WHEN json_valid(response) THEN response END AS response FROM r)
SELECT conv_id, turn, json_extract_string(response, '$.question') AS question, json_extract_string(response, '$.answer') AS answer
FROM v WHERE json_extract_string(response, '$.question') IS NOT NULL AND json_extract_string(response, '$.answer') IS NOT NULL""",
)
def parse_generated(spark: SparkSession, sf: str) -> DataFrame:
    from chatloom.operators.ranking import hash_positions

    turns = standins.table(spark, sf, "conversations")
    found = hash_positions(
        messages.qa_pairs(turns, "conv_id", "turn", "role", "text"), ["conv_id", "turn"], "pairs", "pair"
    )
    payload = F.when(F.col("pair") % 7 == 0, F.to_json(F.struct("question"))).otherwise(F.to_json(F.struct("question", "answer")))
    responses = found.select("conv_id", "turn", standins.broken_json(payload, F.col("pair")).alias("response"))
    parsed = responses.withColumn("qa", text.parse_json_fields(F.col("response"), "question", "answer"))
    return parsed.filter(F.col("qa").isNotNull()).select("conv_id", "turn", "qa.question", "qa.answer")


# ---- media kinds ---------------------------------------------------------------------------------------------------


_CLASSIFY_SQL = """WITH i AS (SELECT page_id, page_id % 7 AS shape, url, 'media/' || page_id || '.wav' AS file,
    CASE WHEN page_id % 3 = 0 THEN 'https://www.youtube.com/watch?v=' || page_id ELSE 'clips/' || page_id || '.mp4' END AS video FROM pages)
SELECT page_id,
  CASE shape WHEN 0 THEN 'array' WHEN 1 THEN 'dataset_ref'
    WHEN 2 THEN CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN 'path_http' ELSE 'path_local' END
    WHEN 3 THEN 'error' WHEN 4 THEN CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN 'text_http' ELSE 'text_local' END
    WHEN 5 THEN 'text_local' ELSE CASE WHEN page_id % 3 = 0 THEN 'text_http' ELSE 'text_local' END END AS audio,
  CASE shape WHEN 4 THEN CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN 'http' ELSE 'error' END
    WHEN 5 THEN CASE WHEN page_id IN (SELECT doc_id FROM labels) THEN 'local' ELSE 'error' END
    WHEN 6 THEN CASE WHEN video LIKE 'https://%' THEN 'http' WHEN page_id IN (SELECT doc_id FROM labels) THEN 'local' ELSE 'error' END
    ELSE 'error' END AS image,
  CASE shape WHEN 3 THEN 'hosted' WHEN 4 THEN CASE WHEN contains(url, 'youtube.com') THEN 'hosted' ELSE 'local' END
    WHEN 5 THEN 'local' WHEN 6 THEN CASE WHEN page_id % 3 = 0 THEN 'hosted' ELSE 'local' END ELSE 'error' END AS video
FROM i"""


@query("classify_item", _CLASSIFY_SQL)
def classify_item(spark: SparkSession, sf: str) -> DataFrame:
    n, url = F.col("page_id"), F.col("url")
    shape = n % 7
    watch = F.when(n % 3 == 0, F.concat(F.lit(fv.VIDEO_URL_PREFIX), n)).otherwise(F.concat(F.lit("clips/"), n, F.lit(".mp4")))
    item = F.struct(
        F.when(shape == 0, F.array(F.lit(0.0), F.lit(0.5))).alias("array"),
        F.when(shape == 0, F.lit(16000).cast("bigint")).alias("sampling_rate"),
        F.when(shape == 1, F.lit("speech")).alias("dataset"),
        F.when(shape == 1, n).alias("idx"),
        # samples that also name a path are still samples
        F.when(shape.isin(0, 2), url).alias("path"),
        F.when(shape == 3, url).alias("url"),
        F.when(shape == 4, url).when(shape == 5, F.concat(F.lit("media/"), n, F.lit(".wav"))).when(shape == 6, watch).alias("text"),
    )
    known = standins.table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), F.lit(True).alias("known"))
    rows = standins.table(spark, sf, "pages").select("page_id", item.alias("item")).join(known, "page_id", "left")
    return rows.select(
        "page_id",
        media.audio_source(F.col("item")).alias("audio"),
        media.image_source(F.col("item"), F.col("known")).alias("image"),
        media.video_source(F.col("item")).alias("video"),
    )


@query("classify_variant", _CLASSIFY_SQL)
def classify_variant(spark: SparkSession, sf: str) -> DataFrame:
    """The same items as they come in JSON, of mixed forms in one stored column."""
    n, url = F.col("page_id"), F.col("url")
    shape = n % 7
    watch = F.when(n % 3 == 0, F.concat(F.lit(fv.VIDEO_URL_PREFIX), n)).otherwise(F.concat(F.lit("clips/"), n, F.lit(".mp4")))
    plain = F.when(shape == 4, url).when(shape == 5, F.concat(F.lit("media/"), n, F.lit(".wav"))).otherwise(watch)
    samples = F.struct(F.array(F.lit(0.0), F.lit(0.5)).alias("array"), F.lit(16000).alias("sampling_rate"), url.alias("path"))
    reference = F.struct(F.struct(F.lit("speech").alias("path")).alias("dataset_args"), n.alias("idx"))
    form = (
        F.when(shape == 0, F.to_json(samples))
        .when(shape == 1, F.to_json(reference))
        .when(shape == 2, F.to_json(F.struct(url.alias("path"))))
        .when(shape == 3, F.to_json(F.struct(url.alias("url"))))
        .otherwise(F.regexp_extract(F.to_json(F.array(plain)), r"(?s)\A\[(.*)\]\z", 1))
    )
    stored = stage(standins.table(spark, sf, "pages").select("page_id", F.parse_json(form).alias("item")), "items")
    known = standins.table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), F.lit(True).alias("known"))
    item = media.VariantItem(F.col("item"))
    return stored.join(known, "page_id", "left").select(
        "page_id",
        media.audio_source(item).alias("audio"),
        media.image_source(item, F.col("known")).alias("image"),
        media.video_source(item).alias("video"),
    )


_SUFFIXES = ["", ".wav", ".jpg", ".JPG", ".jpeg", "/.wav", ".png?size=1"]


@query(
    "classify_extension",
    f"""WITH f AS (SELECT page_id, url || ({sql_list(_SUFFIXES)})[(page_id % 7 + 1)::INT] AS name FROM pages),
  seg AS (SELECT page_id, name, ltrim(string_split(name, '/')[-1], '.') AS base FROM f),
  ext AS (SELECT page_id, name, CASE WHEN contains(base, '.') THEN '.' || string_split(base, '.')[-1] ELSE '' END AS ext FROM seg)
SELECT page_id, name, ext AS extension,
  CASE WHEN ext = '.wav' THEN 'audio' WHEN ext IN ('.jpg', '.png', '.jpeg') THEN 'vision' ELSE 'text' END AS kind FROM ext""",
)
def classify_extension(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("page_id") % 7 + 1).cast("int"))
    named = standins.table(spark, sf, "pages").select("page_id", F.concat("url", suffix).alias("name"))
    return named.select(
        "page_id", "name", media.file_extension(F.col("name")).alias("extension"), media.extension_kind(F.col("name")).alias("kind")
    )


# ---- game ------------------------------------------------------------------------------------------------------------

_LABELS = sql_list([fv.LANDER_ACTION_LABELS[i] for i in range(4)])
_SQL_ACTION = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"


@query(
    "policy_rows",
    f"""WITH r AS (SELECT user_id || '_' || event_id AS id, {_SQL_ACTION} AS action FROM events),
  s AS (SELECT * FROM r WHERE {sql_hash('id', 'policy')} < {int(0.01 * 2**32)}),
  o AS (SELECT id, string_agg(opt, ', ' ORDER BY {sql_order("id || ':' || opt", 'options')}) AS options
        FROM s, (SELECT unnest({sql_list(fv.LANDER_OPTIONS)}) AS opt) GROUP BY id)
SELECT s.id, '/frames/' || s.id || '.jpg' AS images,
  'user: ' || {quote(fv.LANDER_QUESTION)} || o.options || chr(10) || 'assistant: ' || coalesce(({_LABELS})[s.action + 1], '') AS messages
FROM s JOIN o USING (id)""",
)
def policy_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = builders.policy_rows(standins.rollout(spark, sf), "/frames")
    return rows.select("id", F.array_join("images", "|").alias("images"), flat_messages(F.col("messages")).alias("messages"))


@query(
    "label_to_action",
    f"""WITH r AS (SELECT event_id, event_type, {_SQL_ACTION} AS code FROM events)
SELECT event_id, coalesce(({_LABELS})[code + 1], '') || CASE WHEN event_id % 5 = 0 THEN ' ' ELSE '' END AS label,
  (CASE WHEN event_id % 5 = 0 OR code > 3 THEN 0 ELSE code END)::BIGINT AS action FROM r""",
)
def label_to_action(spark: SparkSession, sf: str) -> DataFrame:
    played = standins.rollout(spark, sf).select(
        F.col("frame").alias("event_id"),
        F.concat(builders.action_label(F.col("action")), F.when(F.col("frame") % 5 == 0, " ").otherwise("")).alias("label"),
    )
    return played.select("event_id", "label", builders.label_to_action(F.col("label")).cast("bigint").alias("action"))


# ---- learned sentence ends -----------------------------------------------------------------------------------------


def _sql_log(n: str, p: str) -> str:
    return f"CASE WHEN {n} > 0 THEN ({n}) * ln({p}) ELSE 0 END"


def _sql_binomial(k: str, n: str, p: str) -> str:
    return f"({_sql_log(k, p)} + {_sql_log(f'({n}) - ({k})', f'1 - {p}')})"


def _sql_association(a: str, b: str, both: str, n: str) -> str:
    p, p1, p2 = f"(({b}) / {n}::DOUBLE)", f"({both} / ({a})::DOUBLE)", f"((({b}) - {both}) / nullif({n} - ({a}), 0)::DOUBLE)"
    rest = f"coalesce({p2}, 0)"
    return f"""-2 * ({_sql_binomial(both, a, p)} + {_sql_binomial(f'({b}) - {both}', f'{n} - ({a})', p)}
    - {_sql_binomial(both, a, p1)} - {_sql_binomial(f'({b}) - {both}', f'{n} - ({a})', rest)})"""


def _sql_bare(token: str) -> str:
    return f"rtrim(ltrim({token}, {quote(sentences.OPENING)}), {quote(sentences.CLOSING)})"


def _sql_word(bare: str) -> str:
    word = f"lower(regexp_replace({bare}, '[.!?]+\\z', ''))"
    return f"CASE WHEN regexp_matches({word}, '\\p{{L}}') THEN {word} ELSE '#' END"


SQL_SENTENCES = f"""src AS (SELECT doc_id, replace(replace(replace(text, ' in ', ' e.g. in '), ' die ', ' bzw. die '), ' la ', ' No. 5 la ') AS text FROM documents),
lists AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''), lambda t: {_sql_bare('t')}) AS l FROM src),
toks AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS b FROM lists),
kinds AS (SELECT doc_id, i, {_sql_word('b')} AS word, ends_with(b, '.') AS dot, regexp_matches(b, '[!?]\\z') AS mark FROM toks),
pairs AS (SELECT word, dot, mark, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM kinds),
words AS (SELECT word, count(*) FILTER (dot) AS dotted, count(*) FILTER (NOT dot) AS plain, count(*) AS n FROM kinds GROUP BY word),
size_ AS (SELECT sum(n)::BIGINT AS n, sum(dotted)::DOUBLE / sum(n) AS chance FROM words),
shape AS (SELECT *, length(replace(word, '.', ''))::DOUBLE AS letters FROM words WHERE dotted > 0 AND word <> '#'),
abbreviations AS (SELECT * FROM (
  SELECT word, -2 * ({_sql_binomial('dotted', 'w.n', 'chance')} - {_sql_binomial('dotted', 'w.n', '0.99::DOUBLE')}) * exp(-letters)
    * (length(word) - letters + 1) * letters ** (-plain) AS score FROM shape w, size_) WHERE score >= {sentences.ABBREVIATION}),
ends AS (SELECT * FROM pairs WHERE mark OR (dot AND word <> '#' AND word NOT IN (SELECT word FROM abbreviations))),
starts AS (SELECT next, count(*) AS "both", w.n AS n FROM ends JOIN words w ON w.word = next WHERE regexp_matches(next, '\\p{{L}}') GROUP BY next, w.n),
breaks AS (SELECT count(*) AS a FROM ends),
starters AS (SELECT * FROM (SELECT next, {_sql_association('a', 's.n', '"both"', 'z.n')} AS score FROM starts s, breaks, size_ z
  WHERE z.n / a::DOUBLE > s.n / "both"::DOUBLE) WHERE score >= {sentences.STARTER}),
met AS (SELECT word, next, count(*) AS "both" FROM pairs WHERE dot AND regexp_matches(next, '\\p{{L}}')
  AND (word = '#' OR word IN (SELECT word FROM abbreviations)) AND next NOT IN (SELECT next FROM starters) GROUP BY word, next HAVING count(*) > 1),
collocations AS (SELECT * FROM (SELECT m.word, m.next, {_sql_association('x.dotted', 'y.n', '"both"', 'z.n')} AS score
  FROM met m JOIN words x USING (word) JOIN words y ON y.word = m.next, size_ z WHERE z.n / x.dotted::DOUBLE > y.n / "both"::DOUBLE) WHERE score >= {sentences.COLLOCATION})"""


@query(
    "sentence_model",
    f"""WITH {SQL_SENTENCES} SELECT 'abbreviation' AS kind, word, NULL AS next, round(score, 4) AS score FROM abbreviations
UNION ALL SELECT 'starter', NULL, next, round(score, 4) FROM starters UNION ALL SELECT 'collocation', word, next, round(score, 4) FROM collocations""",
)
def sentence_model(spark: SparkSession, sf: str) -> DataFrame:
    """What the texts tell of their abbreviations, sentence starters and collocations."""
    words, pairs = sentences.word_counts(standins.abbreviated(spark, sf), "text")
    short = stage(sentences.abbreviation_scores(words).filter(F.col("score") >= sentences.ABBREVIATION), "abbreviations")
    starters = stage(sentences.starter_scores(words, pairs, short.select("word")).filter(F.col("score") >= sentences.STARTER), "starters")
    met = sentences.collocation_scores(words, pairs, short, starters).filter(F.col("score") >= sentences.COLLOCATION)
    parts = {"abbreviation": short, "starter": starters, "collocation": met}
    made = [df.withColumn("kind", F.lit(kind)) for kind, df in parts.items()]
    every = made[0].unionByName(made[1], allowMissingColumns=True).unionByName(made[2], allowMissingColumns=True)
    return every.select("kind", "word", "next", F.round("score", 4).alias("score"))


@query(
    "learned_sentences",
    f"""WITH {SQL_SENTENCES},
pieces AS (SELECT doc_id, list_filter(string_split(regexp_replace({sql_strip('text')}, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS l FROM src),
rows_ AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS s FROM pieces),
both_ AS (SELECT *, {_sql_bare("regexp_extract(s, '([^ \\t\\n\\r\\f]+)\\z', 1)")} AS own,
  {_sql_bare("regexp_extract(lead(s) OVER (PARTITION BY doc_id ORDER BY i), '\\A([^ \\t\\n\\r\\f]+)', 1)")} AS follows FROM rows_),
named AS (SELECT *, {_sql_word('own')} AS word, {_sql_word('follows')} AS next FROM both_),
judged AS (SELECT doc_id, i, s, NOT (ends_with(own, '.') AND (c.word IS NOT NULL OR (a.word IS NOT NULL AND NOT (regexp_matches(follows, '\\A\\p{{Lu}}') AND t.next IS NOT NULL)))) AS ends
  FROM named n LEFT JOIN collocations c ON c.word = n.word AND c.next = n.next LEFT JOIN abbreviations a ON a.word = n.word LEFT JOIN starters t ON t.next = n.next),
numbered AS (SELECT doc_id, i, s, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence FROM judged)
SELECT doc_id, sentence, string_agg(s, ' ' ORDER BY i) AS text FROM numbered GROUP BY doc_id, sentence""",
)
def learned_sentences(spark: SparkSession, sf: str) -> DataFrame:
    docs = standins.abbreviated(spark, sf)
    split = sentences.sentence_splitter(sentences.learn_sentences(docs, "text"))
    found = docs.select("doc_id", F.posexplode(split(F.col("text"))).alias("sentence", "text"))
    return found.select("doc_id", F.col("sentence").cast("bigint").alias("sentence"), "text")
