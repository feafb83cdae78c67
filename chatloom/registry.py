"""Modality specifications: what a placeholder token means and how many positions it fills."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def token_code(token: str) -> int:
    """Negative id of a placeholder: the sum of ord(c)**i over the characters, modulo 10000, negated.

    Arbitrary-precision arithmetic, so it is computed here once and enters queries as a literal.
    """
    return -(sum(pow(ord(char), power) for power, char in enumerate(token)) % 10_000)


def patch_count(image_size: int, patch_size: int) -> int:
    per_side = image_size // patch_size
    return per_side * per_side


@dataclass(frozen=True)
class ModalitySpec:
    name: str
    token: str
    data_key: str
    width: int
    item_size: int | None = None
    # user hooks, see operators.hooks: lists of items to lists of values, item values to vectors
    preprocess: Callable[[list[list[Any]]], list[Any]] | None = field(default=None, compare=False)
    encode: Callable[[list[Any]], list[list[float]]] | None = field(default=None, compare=False)
    # run once in a worker; what it returns (a loaded model) is then the first argument of both hooks
    setup: Callable[[], Any] | None = field(default=None, compare=False)

    @property
    def code(self) -> int:
        return token_code(self.token)


# The modalities and their bundles. None = item size depends on the encoder.
BUNDLES: dict[str, list[ModalitySpec]] = {
    "vision_clip": [ModalitySpec("vision_clip", "<image>", "images", patch_count(336, 14))],
    "vision_clip_pool": [ModalitySpec("vision_clip", "<image>", "images", 10, 1024)],
    "audio_whisper": [ModalitySpec("audio_whisper", "<speech>", "speech_audios", 10, 768)],
    "audio_clap": [ModalitySpec("audio_clap", "<sound>", "sounds", 5, 512)],
    "video_xclip": [ModalitySpec("video_xclip", "<video>", "videos", 10, 512)],
    "imagebind": [ModalitySpec("imagebind", "<imagebind>", "imagebinds", 4, 1024)],
    "document_gte": [ModalitySpec("document_gte", "<document>", "documents", 4, 1024)],
    "document_gte_x16": [ModalitySpec("document_gte", "<document>", "documents", 32, 1024)],
}


def check_specs(specs: Iterable[ModalitySpec]) -> list[ModalitySpec]:
    """Reject specifications that could not be told apart inside a sequence."""
    specs = list(specs)
    seen: dict[int, str] = {}
    for spec in specs:
        if not spec.token:
            raise ValueError(f"modality {spec.name}: empty token")
        if spec.code == 0:
            raise ValueError(f"token {spec.token!r} has code 0 and would be read as text")
        if spec.width < 1:
            raise ValueError(f"modality {spec.name}: width must be positive")
        other = seen.setdefault(spec.code, spec.token)
        if other != spec.token:
            raise ValueError(f"tokens {other!r} and {spec.token!r} share code {spec.code}")
    if len({s.token for s in specs}) != len(specs):
        raise ValueError("a token is used by two modalities")
    if len({s.name for s in specs}) != len(specs):
        raise ValueError("a modality name is used twice")
    return specs


def register_bundle(name: str, specs: Iterable[ModalitySpec]) -> list[ModalitySpec]:
    """Add a named bundle; it can then be used wherever a built-in one can."""
    if name in BUNDLES:
        raise ValueError(f"bundle {name} exists")
    BUNDLES[name] = check_specs(specs)
    return BUNDLES[name]


def register_modality(spec: ModalitySpec) -> ModalitySpec:
    """Add a modality of one's own as a bundle of its name."""
    return register_bundle(spec.name, [spec])[0]


def bundle(*names: str) -> list[ModalitySpec]:
    """The specifications of one or several bundles."""
    return check_specs(spec for name in names for spec in BUNDLES[name])


SPEC_SCHEMA = T.StructType(
    [
        T.StructField("bundle", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("token", T.StringType(), False),
        T.StructField("data_key", T.StringType(), False),
        T.StructField("width", T.LongType(), False),
        T.StructField("code", T.LongType(), False),
    ]
)


def spec_table(spark: SparkSession) -> DataFrame:
    """All bundles as a dimension table (one row per bundle and modality, so always tiny)."""
    rows = [(b, s.name, s.token, s.data_key, s.width, s.code) for b, specs in BUNDLES.items() for s in specs]
    return spark.createDataFrame(rows, SPEC_SCHEMA)
