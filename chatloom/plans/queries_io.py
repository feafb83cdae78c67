"""Queries over readers and writers. Files are written to the shared folder first, from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.functions.hashing import pick_index
from chatloom.plans import standins
from chatloom.plans.queries_encode import SPECS, SQL_TURNS
from chatloom.plans.queries_text import SQL_IMAGE, SQL_LOADED, SQL_PAIRS, flat_messages
from chatloom.plans.registry import query, sql_hash
from chatloom.schemas import MESSAGES
from chatloom.session import staging_path
from chatloom.sources import card, files
from chatloom.sources.arrow_files import read_arrow

DIALOGS_PER_FILE = 1000
DIALOG_RANGE = 1 << 16  # so that files have several ranges at every scale


@query(
    "src_chat_roundtrip",
    f"""WITH {SQL_TURNS} SELECT conv_id, count(*) AS n_messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages FROM turns GROUP BY conv_id""",
)
def src_chat_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = staging_path(spark, "chat")
    rows = standins.chats(spark, sf)
    files.write_chat(rows, path)
    back = files.read_chat(spark, path, rows.schema)
    return back.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"), flat_messages(F.col("messages")).alias("messages"))


@query(
    "src_arrow_roundtrip",
    f"""WITH {SQL_TURNS} SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS position, count(*) AS n_messages,
  string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages FROM turns GROUP BY conv_id""",
)
def src_arrow_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Through a folder of ``*.arrow`` files, in order: positions come from the files' rows counted up."""
    path = staging_path(spark, "arrow")
    rows = standins.chats(spark, sf).repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    files.write_chat(rows, path, layout="arrow")
    back = read_arrow(spark, path, ["conv_id", "messages"], place=True)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    first = read_arrow(spark, path, ["conv_id"], place=True).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    first = first.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return back.join(first, "file").select(
        "conv_id",
        (F.col("first") + F.col("row")).alias("position"),
        F.size("messages").cast("bigint").alias("n_messages"),
        flat_messages(F.col("messages")).alias("messages"),
    )


def _write_dialog_arrays(spark: SparkSession, sf: str, path: str) -> None:
    """JSON arrays of about DIALOGS_PER_FILE dialogues each, spread over the files by hash."""
    dialogs = standins.dialogs(spark, sf)
    n_files = max(2, dialogs.count() // DIALOGS_PER_FILE)
    numbered = dialogs.withColumn("part", pick_index(F.col("id"), "file", n_files))
    arrays = numbered.groupBy("part").agg(
        F.to_json(F.collect_list(F.struct("id", "image", "conversations"))).alias("value")
    )
    arrays.write.partitionBy("part").text(path)


@query(
    "src_dialog_json",
    f"""SELECT conv_id::VARCHAR AS id, {SQL_IMAGE.format(id='conv_id')} AS image, count(*) AS n_turns,
  string_agg(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END || ': '
    || CASE WHEN turn = 0 THEN '<image>' || chr(10) ELSE '' END || CASE WHEN role = 'user' THEN {SQL_LOADED.format(id='conv_id')} ELSE '' END || text,
    chr(10) ORDER BY turn) AS turns FROM conversations GROUP BY conv_id""",
)
def src_dialog_json(spark: SparkSession, sf: str) -> DataFrame:
    path = staging_path(spark, "dialogs")
    _write_dialog_arrays(spark, sf, path)
    back = files.read_dialog_json(spark, [f"{path}/part=*"], split_bytes=DIALOG_RANGE)
    return back.select(
        "id",
        "image",
        F.size("conversations").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("conversations", lambda t: F.concat(t["from"], F.lit(": "), t["value"])), "\n").alias("turns"),
    )


@query("src_jsonl_glob", "SELECT doc_id, text, lang, source FROM documents")
def src_jsonl_glob(spark: SparkSession, sf: str) -> DataFrame:
    path = staging_path(spark, "jsonl")
    standins.table(spark, sf, "documents").select("doc_id", "text", "lang", "source").write.partitionBy("lang").json(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])
    lines = files.read_jsonl(spark, f"{path}/lang=*/*.json", schema, corrupt="bad_line")
    # the language is part of the path only
    lang = F.regexp_extract(F.col("_metadata.file_path"), r"/lang=([^/]*)/", 1)
    return lines.filter(F.col("bad_line").isNull()).select("doc_id", "text", lang.alias("lang"), "source")


N_FOLDERS = 32


@query(
    "src_manifest",
    f"""SELECT {sql_hash('page_id', 'folder')} % {N_FOLDERS} AS folder, sum(strlen(html) + 1)::BIGINT AS bytes FROM pages GROUP BY folder""",
)
def src_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Files below a folder with their lengths, summed per subfolder (each row is one line of a text file)."""
    root = staging_path(spark, "media")
    pages = standins.table(spark, sf, "pages")
    pages.select(F.col("html").alias("value"), pick_index(F.col("page_id"), "folder", N_FOLDERS).alias("folder")).write.partitionBy("folder").text(root)
    listed = files.read_manifest(spark, root)
    folder = F.regexp_extract("path", r"/folder=(\d+)/", 1).cast("bigint")
    return listed.groupBy(folder.alias("folder")).agg(F.sum("length").alias("bytes"))


@query(
    "sink_cache_jsonl",
    f"""WITH {SQL_PAIRS} SELECT pair, question, answer, 'first' AS run FROM pairs WHERE length(question) % 2 = 0
UNION ALL SELECT pair, question, answer, 'second' FROM pairs WHERE length(question) % 2 = 1""",
)
def sink_cache_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs append to one cache; both are there on reading back."""
    folder = staging_path(spark, "cache")
    pairs = standins.pairs(spark, sf)
    for run, rest in (("first", 0), ("second", 1)):
        files.write_cache_jsonl(pairs.filter(F.length("question") % 2 == rest).withColumn("run", F.lit(run)), folder)
    schema = T.StructType(
        [T.StructField("pair", T.LongType())] + [T.StructField(n, T.StringType()) for n in ("question", "answer", "run")]
    )
    return files.read_jsonl(spark, folder, schema)


@query(
    "dataset_card",
    f"""WITH {SQL_TURNS}, f AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS first_messages, count(*) AS first_size FROM turns GROUP BY conv_id)
SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS num_examples, first_messages, first_size,
  '* vision_clip (use `<image>` in text and provide `images`, encoded as 10 tokens)' || chr(10)
  || '* document_gte (use `<document>` in text and provide `documents`, encoded as 4 tokens)' AS modalities
FROM f ORDER BY conv_id LIMIT 1""",
)
def dataset_card(spark: SparkSession, sf: str) -> DataFrame:
    described = card.dataset_card(standins.chats(spark, sf), "conv_id", SPECS)
    example = F.from_json("first_example", T.StructType([T.StructField("messages", MESSAGES)]))["messages"]
    return described.select(
        "num_examples", flat_messages(example).alias("first_messages"), F.size(example).cast("bigint").alias("first_size"), "modalities"
    )
