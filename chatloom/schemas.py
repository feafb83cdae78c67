"""Explicit schemas of the data model."""

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)

# {path, name, split} of a dataset, and the row it points to
DATASET_ARGS = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "name", "split")])
DATASET_REF = T.StructType([T.StructField("dataset_args", DATASET_ARGS), T.StructField("idx", T.LongType())])

CLIP = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("start_time", T.DoubleType()),
        T.StructField("end_time", T.DoubleType()),
    ]
)

# the union of all media item shapes, one field per alternative
ITEM_STRUCT = T.StructType(
    [
        T.StructField("array", T.ArrayType(T.DoubleType())),
        T.StructField("sampling_rate", T.LongType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("idx", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

DIALOG = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField(
            "conversations",
            T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])),
        ),
    ]
)


def chat_schema(*item_columns: str, item_type: T.DataType | None = None) -> T.StructType:
    """``id``, the given item columns, ``messages``."""
    item_type = item_type or T.StringType()
    return T.StructType(
        [T.StructField("id", T.StringType())]
        + [T.StructField(c, T.ArrayType(item_type)) for c in item_columns]
        + [T.StructField("messages", MESSAGES)]
    )
