"""Queries over the encoder: rendering, splitting, tokens, labels, chunks, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom import fixed_values as fv
from chatloom.functions import chat
from chatloom.operators import chunking, collating, encoding, fallback, subwords, turns
from chatloom.plans import standins
from chatloom.plans.batches import requests, training_batches
from chatloom.plans.registry import query, quote, sql_order
from chatloom.registry import bundle, spec_table
from chatloom.session import stage

SPECS = bundle("vision_clip_pool", "document_gte")
BATCH, MAX_LENGTH = 4, 2048


def ids_text(col: Column | str) -> Column:
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


# ---- shared SQL ----------------------------------------------------------------------------------------------

SQL_TURNS = """first_user AS (SELECT conv_id, min(turn) AS fu FROM conversations WHERE role = 'user' GROUP BY conv_id),
turns AS (SELECT c.conv_id, c.turn, c.role,
    CASE WHEN c.turn = f.fu THEN repeat('<image>', (c.conv_id % 4)::INT) || c.text || CASE WHEN c.conv_id % 3 = 0 THEN ' <document>' ELSE '' END
         WHEN c.role = 'assistant' AND c.conv_id % 11 = 0 THEN c.text || ' <image>' ELSE c.text END AS text
  FROM conversations c LEFT JOIN first_user f USING (conv_id))"""

SQL_CHATS = f"""{SQL_TURNS},
chats AS (SELECT conv_id, '<s>' || string_agg(CASE WHEN role = 'user' THEN '[INST] ' || text || ' [/INST]' ELSE text || '</s>' END, '' ORDER BY turn) AS chat,
    bool_and(role = CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END) AS alternates
  FROM turns GROUP BY conv_id),
part_lists AS (SELECT conv_id, alternates, list_filter(string_split(regexp_replace(chat, '(\\[INST\\][\\s\\S]*?\\[/INST\\])', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS l FROM chats),
parts AS (SELECT conv_id, alternates, unnest(l) AS part, generate_subscripts(l, 1) AS part_no FROM part_lists),
piece_lists AS (SELECT conv_id, alternates, part_no, contains(part, '[INST]') AS instruction,
    list_filter(string_split(regexp_replace(part, '(<image>|<document>)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS l FROM parts),
raw_pieces AS (SELECT conv_id, alternates, part_no, instruction, unnest(l) AS text, generate_subscripts(l, 1) AS sub_no FROM piece_lists),
pieces AS (SELECT conv_id, alternates, instruction, text, text IN ('<image>', '<document>') AS placeholder,
    row_number() OVER (PARTITION BY conv_id ORDER BY part_no, sub_no) - 1 AS piece FROM raw_pieces),
verdicts AS (SELECT conv_id, CASE WHEN NOT bool_and(alternates) THEN 'roles do not alternate from user'
    WHEN bool_or(placeholder AND NOT instruction) THEN 'placeholder outside an instruction' END AS error
  FROM pieces GROUP BY conv_id)"""

_PATTERN = quote(fv.TOKEN_PATTERN)
SQL_TOKENS = f"""{SQL_CHATS},
token_lists AS (SELECT p.conv_id, p.piece, p.instruction, p.placeholder, p.text,
    CASE WHEN p.text = '<image>' THEN list_transform(range(10), lambda i: p.text)
         WHEN p.text = '<document>' THEN list_transform(range(4), lambda i: p.text)
         ELSE regexp_extract_all(p.text, {_PATTERN}) END AS l
  FROM pieces p JOIN verdicts v USING (conv_id) WHERE v.error IS NULL),
flat AS (SELECT conv_id, piece, instruction, placeholder, unnest(l) AS token, generate_subscripts(l, 1) AS no FROM token_lists),
tokens AS (SELECT conv_id, instruction, placeholder, token,
    row_number() OVER (PARTITION BY conv_id ORDER BY piece, no) - 1 AS pos FROM flat)"""


def sql_vocab(min_freq: int = 1) -> str:
    return f"""counts AS (SELECT token, count(*) AS freq FROM tokens WHERE NOT placeholder GROUP BY token),
vocab AS (SELECT token, row_number() OVER (ORDER BY {sql_order('token', 'vocab')}, token) + 2 AS id, freq
    FROM counts WHERE token NOT IN ('<unk>', '<s>', '</s>') AND freq >= {min_freq}
  UNION ALL SELECT s.token, s.id, coalesce(c.freq, 0) FROM (VALUES ('<unk>', 0), ('<s>', 1), ('</s>', 2)) s(token, id) LEFT JOIN counts c ON s.token = c.token)"""


def sql_ids(min_freq: int = 1) -> str:
    return f"""{SQL_TOKENS}, {sql_vocab(min_freq)},
ids AS (SELECT t.conv_id, t.pos, t.instruction OR t.placeholder AS masked, t.token,
    CASE WHEN t.token = '<image>' AND t.placeholder THEN -1626 WHEN t.placeholder THEN -7240 ELSE coalesce(v.id, 0) END AS id
  FROM tokens t LEFT JOIN vocab v ON t.token = v.token AND NOT t.placeholder),
encoded AS (SELECT conv_id, list(id ORDER BY pos) AS input_ids, list(CASE WHEN masked THEN -100 ELSE id END ORDER BY pos) AS labels
  FROM ids GROUP BY conv_id)"""


# ---- flagship -------------------------------------------------------------------------------------------------------

_PLAIN = SQL_CHATS.replace(SQL_TURNS, "turns AS (SELECT conv_id, turn, role, text FROM conversations)")


@query(
    "supervised_tokens",
    f"""WITH {_PLAIN},
n AS (SELECT conv_id, instruction, len(regexp_extract_all(text, {_PATTERN})) AS n FROM pieces JOIN verdicts USING (conv_id) WHERE error IS NULL)
SELECT conv_id, sum(CASE WHEN instruction THEN 0 ELSE n END)::BIGINT AS trained_tokens,
  sum(CASE WHEN instruction THEN n ELSE 0 END)::BIGINT AS masked_tokens FROM n GROUP BY conv_id""",
)
def supervised_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return turns.token_accounting(standins.table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


# ---- rendering and splitting --------------------------------------------------------------------------------------------


@query(
    "render_chat",
    f"WITH {SQL_CHATS} SELECT conv_id, chat, CASE WHEN alternates THEN 'ok' ELSE 'error' END AS verdict FROM chats",
)
def render_chat(spark: SparkSession, sf: str) -> DataFrame:
    rows = standins.chats(spark, sf)
    return rows.select(
        "conv_id",
        chat.render_chat(F.col("messages")).alias("chat"),
        F.when(chat.role_error(F.col("messages")).isNull(), "ok").otherwise("error").alias("verdict"),
    )


@query(
    "split_instructions",
    f"""WITH {SQL_CHATS} SELECT conv_id, part_no - 1 AS part, contains(part, '[INST]') AS instruction, part AS text FROM parts""",
)
def split_instructions(spark: SparkSession, sf: str) -> DataFrame:
    rendered = standins.chats(spark, sf).select("conv_id", chat.render_chat(F.col("messages")).alias("chat"))
    parts = rendered.select("conv_id", F.posexplode(chat.split_instructions(F.col("chat"))).alias("part", "text"))
    return parts.select(
        "conv_id", F.col("part").cast("bigint").alias("part"), chat.is_instruction(F.col("text")).alias("instruction"), "text"
    )


@query(
    "split_placeholders",
    f"WITH {SQL_CHATS} SELECT conv_id, piece, instruction, placeholder, text FROM pieces",
)
def split_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    pieces = encoding.with_pieces(standins.chats(spark, sf), SPECS)
    return pieces.select("conv_id", F.posexplode_outer("pieces").alias("piece", "p")).select(
        "conv_id", F.col("piece").cast("bigint").alias("piece"), "p.instruction", "p.placeholder", "p.text"
    )


@query(
    "encode_errors",
    f"""WITH {SQL_CHATS}, m AS (SELECT conv_id, bool_or(contains(text, '[INST]') OR contains(text, '[/INST]')) AS has_marks FROM turns GROUP BY conv_id)
SELECT conv_id, error, has_marks FROM verdicts JOIN m USING (conv_id)""",
)
def encode_errors(spark: SparkSession, sf: str) -> DataFrame:
    return turns.encode_errors(standins.chat_turns(spark, sf), "conv_id", "turn", "role", "text", SPECS)


@query(
    "placeholder_counts",
    f"""WITH {SQL_CHATS}, s(name, token, width) AS (VALUES ('vision_clip', '<image>', 10), ('document_gte', '<document>', 4)),
c AS (SELECT DISTINCT conv_id FROM pieces)
SELECT c.conv_id, s.name, count(p.text) AS placeholders, s.width::BIGINT AS width
FROM c CROSS JOIN s LEFT JOIN pieces p ON p.conv_id = c.conv_id AND p.text = s.token GROUP BY ALL""",
)
def placeholder_counts(spark: SparkSession, sf: str) -> DataFrame:
    return turns.placeholder_counts(standins.chat_turns(spark, sf), "conv_id", "text", SPECS)


@query(
    "validate_items",
    f"""WITH {SQL_TURNS}, p AS (SELECT conv_id,
    sum(len(string_split(text, '<image>')) - 1)::BIGINT AS images, sum(len(string_split(text, '<document>')) - 1)::BIGINT AS documents FROM turns GROUP BY conv_id),
q AS (SELECT conv_id, 'vision_clip' AS name, images AS placeholders,
    (conv_id % 4 - CASE WHEN conv_id % 10 = 6 AND conv_id % 4 > 0 THEN 1 ELSE 0 END + CASE WHEN conv_id % 10 = 7 THEN 1 ELSE 0 END)::BIGINT AS items FROM p
  UNION ALL SELECT conv_id, 'document_gte', documents, (CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT FROM p)
SELECT *, CASE WHEN items < placeholders THEN 'too few items' WHEN items > placeholders THEN 'surplus items' ELSE 'ok' END AS verdict FROM q""",
)
def validate_items(spark: SparkSession, sf: str) -> DataFrame:
    items = standins.chats(spark, sf).select("conv_id", *[s.data_key for s in SPECS])
    return turns.validate_items(standins.chat_turns(spark, sf), items, "conv_id", "text", SPECS)


@query(
    "modality_specs",
    f"""WITH {SQL_CHATS}, s(bundle, name, token, data_key, width, code) AS (VALUES
  ('vision_clip', 'vision_clip', '<image>', 'images', 576, -1626), ('vision_clip_pool', 'vision_clip', '<image>', 'images', 10, -1626),
  ('audio_whisper', 'audio_whisper', '<speech>', 'speech_audios', 10, -8565), ('audio_clap', 'audio_clap', '<sound>', 'sounds', 5, -9634),
  ('video_xclip', 'video_xclip', '<video>', 'videos', 10, -8680), ('imagebind', 'imagebind', '<imagebind>', 'imagebinds', 4, -2755),
  ('document_gte', 'document_gte', '<document>', 'documents', 4, -7240), ('document_gte_x16', 'document_gte', '<document>', 'documents', 32, -7240)),
p AS (SELECT text AS token, count(*) AS n FROM pieces GROUP BY text)
SELECT s.bundle, s.name, s.token, s.data_key, s.width::BIGINT AS width, s.code::BIGINT AS code, coalesce(p.n, 0) AS placeholders, (coalesce(p.n, 0) * s.width)::BIGINT AS positions
FROM s LEFT JOIN p USING (token)""",
)
def modality_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Every specification with the positions its placeholders would fill in the chats."""
    found = turns.placeholder_counts(standins.chat_turns(spark, sf), "conv_id", "text", SPECS)
    counts = found.groupBy("name").agg(F.sum("placeholders").alias("n"))
    return spec_table(spark).join(F.broadcast(counts), "name", "left").select(
        "bundle", "name", "token", "data_key", "width", "code",
        F.coalesce("n", F.lit(0)).alias("placeholders"),
        (F.coalesce("n", F.lit(0)) * F.col("width")).alias("positions"),
    )


@query(
    "piece_offsets",
    f"""WITH {SQL_CHATS}, l AS (SELECT conv_id, piece, instruction,
    CASE WHEN text = '<image>' THEN 10 WHEN text = '<document>' THEN 4 ELSE len(regexp_extract_all(text, {_PATTERN})) END AS length
  FROM pieces JOIN verdicts USING (conv_id) WHERE error IS NULL)
SELECT conv_id, piece, instruction, length::BIGINT AS length,
  coalesce(sum(length) OVER (PARTITION BY conv_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM l""",
)
def piece_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return turns.piece_offsets(encodable(spark, sf), "conv_id", "turn", SPECS)


# ---- vocabulary and sequences --------------------------------------------------------------------------------------------


def encodable(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of all chats that can be encoded, cut into pieces and staged: most queries read them twice."""
    found = turns.encodable_turns(standins.chat_turns(spark, sf), "conv_id", "turn", "role", "text", SPECS)
    return stage(found, "encodable")


@query("build_vocab", f"WITH {SQL_TOKENS}, {sql_vocab()} SELECT token, id::BIGINT AS token_id, freq FROM vocab")
def build_vocab(spark: SparkSession, sf: str) -> DataFrame:
    found = turns.encodable_turns(standins.chat_turns(spark, sf), "conv_id", "turn", "role", "text", SPECS)
    return encoding.build_vocab(turns.turn_tokens(found, "conv_id", "turn", SPECS))


@query("subword_ids")
def subword_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of every document by a public byte-level vocabulary."""
    import public_tokenizers

    ranks = subwords.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = standins.table(spark, sf, "documents").select("doc_id", "text")
    found = subwords.encode_subwords(docs, "doc_id", "text", ranks)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.md5(ids_text("ids")).alias("ids_md5"))


@query(
    "encode_chat",
    f"""WITH {sql_ids()} SELECT conv_id, array_to_string(input_ids, ' ') AS input_ids, array_to_string(labels, ' ') AS labels FROM encoded""",
)
def encode_chat(spark: SparkSession, sf: str) -> DataFrame:
    encoded = encoding.encode_chat(standins.chats(spark, sf), "conv_id", SPECS)
    return encoded.select("conv_id", ids_text("input_ids").alias("input_ids"), ids_text("labels").alias("labels"))


@query(
    "encode_turns",
    f"""WITH {sql_ids()},
owner AS (SELECT p.conv_id, p.piece, CASE WHEN p.piece = 0 THEN 0 ELSE sum(CASE WHEN p.text LIKE '[INST]%' THEN 1 WHEN p.piece > 0 AND NOT p.instruction THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id ORDER BY p.piece) - 1 END AS turn FROM pieces p),
placed AS (SELECT f.conv_id, o.turn, row_number() OVER (PARTITION BY f.conv_id ORDER BY f.piece, f.no) - 1 AS pos FROM flat f JOIN owner o USING (conv_id, piece))
SELECT conv_id, turn::BIGINT AS turn, min(pos)::BIGINT AS start, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS input_ids,
  string_agg(CASE WHEN masked THEN '-100' ELSE id::VARCHAR END, ' ' ORDER BY pos) AS labels
FROM placed JOIN ids USING (conv_id, pos) GROUP BY conv_id, turn""",
)
def encode_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The encoded sequences in one piece per turn, for chats of any length."""
    found = encodable(spark, sf)
    vocab = encoding.build_vocab(turns.turn_tokens(found, "conv_id", "turn", SPECS))
    encoded = turns.encode_turns(found, "conv_id", "turn", SPECS, vocab)
    return encoded.select("conv_id", "turn", "start", ids_text("input_ids").alias("input_ids"), ids_text("labels").alias("labels"))


@query(
    "label_accounting",
    f"""WITH {sql_ids()} SELECT conv_id, len(list_filter(labels, lambda x: x <> -100)) AS trained_tokens,
  len(list_filter(labels, lambda x: x = -100)) AS masked_tokens FROM encoded""",
)
def label_accounting(spark: SparkSession, sf: str) -> DataFrame:
    return turns.token_accounting(standins.chat_turns(spark, sf), "conv_id", "turn", "role", "text", SPECS)


# ---- fallback and batches ---------------------------------------------------------------------------------------------------


def checked_chats(spark: SparkSession, sf: str) -> DataFrame:
    """``conv_id, messages, ok``."""
    rows = encoding.with_pieces(standins.chats(spark, sf), SPECS)
    return rows.select("conv_id", "messages", F.col("error").isNull().alias("ok"))


SQL_FALLBACK = """fallback AS (SELECT v.conv_id, coalesce((SELECT min(g.conv_id) FROM verdicts g WHERE g.error IS NULL AND g.conv_id >= v.conv_id),
    (SELECT min(g.conv_id) FROM verdicts g WHERE g.error IS NULL)) AS source FROM verdicts v)"""


@query(
    "fallback_next",
    f"""WITH {SQL_CHATS}, {SQL_FALLBACK},
m AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages FROM turns GROUP BY conv_id)
SELECT f.conv_id, f.source, m.messages FROM fallback f JOIN m ON m.conv_id = f.source""",
)
def fallback_next(spark: SparkSession, sf: str) -> DataFrame:
    from chatloom.plans.queries_text import flat_messages

    # the rows are read three times: flags, good rows, replacements
    rows = stage(checked_chats(spark, sf), "checked")
    filled = fallback.fallback_next(rows, "conv_id", "ok")
    return filled.select("conv_id", "source", flat_messages(F.col("messages")).alias("messages"))


@query(
    "collate_batches",
    f"""WITH {sql_ids(2)}, {SQL_FALLBACK},
rows_ AS (SELECT f.conv_id, f.conv_id // {BATCH} AS batch_id, e.input_ids, e.labels FROM fallback f JOIN encoded e ON e.conv_id = f.source),
longest AS (SELECT batch_id, max(len(input_ids)) AS n FROM rows_ GROUP BY batch_id),
padded AS (SELECT conv_id, batch_id,
    (input_ids || list_transform(range(n - len(input_ids)), lambda i: 0::BIGINT))[1:{MAX_LENGTH}] AS input_ids,
    (labels || list_transform(range(n - len(labels)), lambda i: -100::BIGINT))[1:{MAX_LENGTH}] AS labels
  FROM rows_ JOIN longest USING (batch_id))
SELECT conv_id, batch_id::BIGINT AS batch_id, array_to_string(input_ids, ' ') AS input_ids, array_to_string(labels, ' ') AS labels,
  array_to_string(list_transform(input_ids, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), ' ') AS attention_mask FROM padded""",
)
def collate_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Words seen once are unknown here, so that the mask shows what padding with the unknown token does."""
    special = {"unk": encoding.UNK_ID, "pad": None}
    batches = training_batches(standins.chats(spark, sf), "conv_id", SPECS, BATCH, MAX_LENGTH, special, min_freq=2)
    return batches.select(
        "conv_id", "batch_id", ids_text("input_ids").alias("input_ids"), ids_text("labels").alias("labels"),
        F.array_join(F.transform("attention_mask", lambda b: b.cast("int").cast("string")), " ").alias("attention_mask"),
    )


@query(
    "decode_outputs",
    f"""WITH {sql_ids()}, cut AS (SELECT conv_id, max(CASE WHEN masked THEN pos + 1 ELSE 0 END) AS n FROM ids GROUP BY conv_id)
SELECT i.conv_id, coalesce(string_agg(CASE WHEN i.pos >= c.n AND i.token NOT IN ('<unk>', '<s>', '</s>') THEN i.token END, ' ' ORDER BY i.pos), '') AS output
FROM ids i JOIN cut c USING (conv_id) GROUP BY i.conv_id""",
)
def decode_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """The last answer of each chat as a generated sequence behind its prompt."""
    tokens = stage(turns.positions(encodable(spark, sf), "conv_id", "turn", SPECS), "tokens")
    vocab = encoding.build_vocab(tokens)
    encoded = encoding.collect_sequences(encoding.attach_ids(tokens, vocab), "conv_id")
    last_masked = F.array_max(F.transform("labels", lambda x, i: F.when(x == fv.IGNORE_INDEX, i + 1).otherwise(0)))
    outputs = encoded.select("conv_id", "input_ids", last_masked.alias("prompt_length"))
    return collating.decode_outputs(outputs, "conv_id", "input_ids", "prompt_length", vocab, list(encoding.SPECIAL_IDS.values()))


@query(
    "encode_requests",
    f"""WITH {sql_ids()}, last AS (SELECT conv_id, max_by(role, turn) AS role FROM turns GROUP BY conv_id)
SELECT conv_id, array_to_string(input_ids, ' ') AS input_ids, len(input_ids) AS prompt_length FROM encoded JOIN last USING (conv_id) WHERE role = 'user'""",
)
def encode_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Chats that end with a question, ready to be answered."""
    vocab = encoding.build_vocab(turns.turn_tokens(encodable(spark, sf), "conv_id", "turn", SPECS))
    found = requests(standins.chats(spark, sf), "conv_id", SPECS, vocab)
    return found.select("conv_id", ids_text("input_ids").alias("input_ids"), F.col("prompt_length").cast("bigint").alias("prompt_length"))


# ---- documents -----------------------------------------------------------------------------------------------------------------


def sql_chunks(source: str, key: str, text: str, window: int) -> str:
    """Greedy packing sentence by sentence; chunk numbers start at 0 and an oversized first sentence is in chunk 1."""
    return f"""sentence_lists AS (SELECT {key} AS k, list_filter(string_split(regexp_replace({text}, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS l FROM {source}),
sentences AS MATERIALIZED (SELECT k, generate_subscripts(l, 1) AS i, unnest(l) AS s FROM sentence_lists),
sized AS MATERIALIZED (SELECT k, i, s, len(regexp_extract_all(s, {_PATTERN})) AS n FROM sentences),
packed AS (
  SELECT k, 0::BIGINT AS i, 0::BIGINT AS c, 0::BIGINT AS n FROM sentence_lists
  UNION ALL
  SELECT z.k, z.i, CASE WHEN p.n + z.n > {window} THEN p.c + 1 ELSE p.c END, CASE WHEN p.n + z.n > {window} THEN z.n ELSE p.n + z.n END
  FROM packed p JOIN sized z ON z.k = p.k AND z.i = p.i + 1),
chunk_numbers AS (SELECT k, unnest(range(max(c) + 1)) AS c FROM packed GROUP BY k),
chunk_texts AS (SELECT p.k, p.c, sum(z.n)::BIGINT AS tokens, count(*) AS sentences, string_agg(z.s, ' ' ORDER BY z.i) AS text
  FROM packed p JOIN sized z ON z.k = p.k AND z.i = p.i GROUP BY p.k, p.c),
chunks AS (SELECT k, c, coalesce(tokens, 0) AS tokens, coalesce(sentences, 0) AS sentences, coalesce(text, '') AS text
  FROM chunk_numbers LEFT JOIN chunk_texts USING (k, c))"""


@query(
    "chunk_documents",
    f"""WITH RECURSIVE {sql_chunks('documents', 'doc_id', 'text', 64)}
SELECT k AS doc_id, c AS chunk, tokens, sentences, text FROM chunks""",
)
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = standins.table(spark, sf, "documents").select("doc_id", "text")
    chunked = chunking.chunk_documents(docs, "text", window=64)
    return chunked.select("doc_id", F.posexplode_outer("chunks").alias("chunk", "c")).select(
        "doc_id", F.col("chunk").cast("bigint").alias("chunk"), "c.tokens", "c.sentences", "c.text"
    )


@query(
    "clip_documents",
    f"""WITH RECURSIVE {sql_chunks('documents', 'doc_id', 'text', 512)},
t AS (SELECT k, c, regexp_extract_all(text, {_PATTERN})[1:512] AS l FROM chunks),
longest AS (SELECT k, max(len(l)) AS n FROM t GROUP BY k)
SELECT k AS doc_id, c AS chunk, md5(array_to_string(l || list_transform(range(n - len(l)), lambda i: '[PAD]'), ' ')) AS tokens_md5,
  n::BIGINT AS length, len(l)::BIGINT AS attended FROM t JOIN longest USING (k)""",
)
def clip_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = standins.table(spark, sf, "documents").select("doc_id", "text")
    chunked = chunking.chunk_documents(docs, "text").withColumn("texts", chunking.chunk_texts(F.col("chunks")))
    clipped = chunking.clip_documents(chunked, "texts").select("doc_id", F.posexplode_outer("clipped").alias("chunk", "c"))
    return clipped.select(
        "doc_id",
        F.col("chunk").cast("bigint").alias("chunk"),
        F.md5(F.array_join("c.tokens", " ")).alias("tokens_md5"),
        F.size("c.tokens").cast("bigint").alias("length"),
        F.aggregate("c.mask", F.lit(0).cast("bigint"), lambda a, m: a + m).alias("attended"),
    )
