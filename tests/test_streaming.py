from pyspark.sql import functions as F

from chatloom.functions import chat
from chatloom.operators import chunking
from chatloom.schemas import MESSAGES
from pyspark.sql import types as T


def test_row_local_functions_run_on_a_stream(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("messages", MESSAGES)])
    rows = spark.createDataFrame([(i, [{"role": "user", "content": "One. Two."}]) for i in range(5)], schema)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = stream.select("id", chat.split_instructions(chat.render_chat(F.col("messages"))).alias("parts"), F.col("messages")[0]["content"].alias("text"))
    out = chunking.chunk_documents(out, "text", window=3)
    query = out.writeStream.format("memory").queryName("chats_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.table("chats_out").collect()
    assert len(got) == 5 and got[0]["parts"] == ["<s>", "[INST] One. Two. [/INST]"]
    assert [c["text"] for c in got[0]["chunks"]] == ["One.", "Two."]
