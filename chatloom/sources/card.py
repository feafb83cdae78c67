"""Dataset card."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom import fixed_values as fv
from chatloom.registry import ModalitySpec


def dataset_card(df: DataFrame, key: str, specs: Sequence[ModalitySpec]) -> DataFrame:
    """One row: number of examples, the first example as JSON, one line per modality.

    Count and first example come out of one aggregation; ``min_by`` carries a single row per task.
    """
    lines = "\n".join(
        fv.CARD_MODALITY_LINE.format(name=s.name, token=s.token, data_key=s.data_key, width=s.width) for s in specs
    )
    example = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    return df.agg(
        F.count(F.lit(1)).alias("num_examples"), F.min_by(example, F.col(key)).alias("first_example")
    ).withColumn("modalities", F.lit(lines))
