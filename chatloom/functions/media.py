"""Paths, clip times, media kinds and image/video geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom import fixed_values as fv
from chatloom.functions.hashing import pick_index

_NUMBER = r"\A\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*\z"


def join_path(root: str | Column, rel: Column) -> Column:
    """Path below a root; an absolute ``rel`` stands alone and no slash is doubled."""
    root = F.lit(root) if isinstance(root, str) else root
    return (
        F.when(rel.startswith("/") | (root == ""), rel)
        .when(root.endswith("/"), F.concat(root, rel))
        .otherwise(F.concat(root, F.lit("/"), rel))
    )


def dup_second_segment(path: Column) -> Column:
    """``a/b/c`` to ``a/b/b/c``; NULL for a path of fewer than two segments.

    Empty segments vanish, and a trailing slash stays, as when the segments are joined one by one.
    """
    parts = F.split(path, "/", -1)
    doubled = F.concat(F.slice(parts, 1, 2), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))
    kept = F.array_join(F.filter(doubled, lambda p: p != ""), "/")
    tail = F.when((F.element_at(parts, -1) == "") & (kept != ""), "/").otherwise("")
    return F.when(F.size(parts) >= 2, F.concat(kept, tail))


def file_extension(name: Column) -> Column:
    """Suffix from the last dot of the last segment; leading dots of a file name do not count."""
    return F.regexp_extract(name, r"[^./][^/]*(\.[^./]*)\z", 1)


def extension_kind(name: Column) -> Column:
    """``audio``, ``vision`` or ``text`` by a case-sensitive extension."""
    ext = file_extension(name)
    return (
        F.when(ext.isin(*fv.AUDIO_EXTENSIONS), "audio")
        .when(ext.isin(*fv.VISION_EXTENSIONS), "vision")
        .otherwise("text")
    )


def _is_http(text: Column) -> Column:
    return F.coalesce(text.startswith("http://") | text.startswith("https://"), F.lit(False))


class VariantItem:
    """A media item stored as VARIANT, in the form its source had: text, or an object with the fields of one kind.

    ``item["path"]`` is that field, read from the stored value by ``try_variant_get``; it stands for the tagged struct in
    the functions below, so that no row carries the fields of forms that it has not.
    """

    _KINDS = {"array": "array<double>", "sampling_rate": "bigint", "idx": "bigint"}
    _PATHS = {"dataset": "$.dataset_args.path"}

    def __init__(self, stored: Column):
        self.stored = stored

    def __getitem__(self, name: str) -> Column:
        if name == "text":  # the value itself
            return F.when(F.schema_of_variant(self.stored) == "STRING", F.try_variant_get(self.stored, "$", "string"))
        return F.try_variant_get(self.stored, self._PATHS.get(name, f"$.{name}"), self._KINDS.get(name, "string"))


def audio_source(item: Column | VariantItem) -> Column:
    """How an audio item is to be loaded.

    ``item`` is the tagged struct ``ITEM_STRUCT`` of chatloom.schemas, or a VARIANT in the form of its source
    (``VariantItem``); the tests run in a fixed order, so a value that carries both samples and a path is read as samples.
    """
    return (
        F.when(item["array"].isNotNull() & item["sampling_rate"].isNotNull(), "array")
        .when(item["dataset"].isNotNull(), "dataset_ref")
        .when(item["path"].isNotNull(), F.when(_is_http(item["path"]), "path_http").otherwise("path_local"))
        .when(item["text"].isNotNull(), F.when(_is_http(item["text"]), "text_http").otherwise("text_local"))
        .otherwise("error")
    )


def image_source(item: Column | VariantItem, path_exists: Column) -> Column:
    """``http``, ``local`` (the path must exist) or ``error``; only plain text names an image."""
    return (
        F.when(_is_http(item["text"]), "http")
        .when(item["text"].isNotNull() & F.coalesce(path_exists, F.lit(False)), "local")
        .otherwise("error")
    )


def video_source(item: Column | VariantItem) -> Column:
    """A struct with any non-empty url is a hosted video; plain text is one only if it names the video host."""
    return (
        F.when(F.coalesce(item["url"], F.lit("")) != "", "hosted")
        .when(item["text"].contains(fv.VIDEO_HOST), "hosted")
        .when(item["text"].isNotNull(), "local")
        .otherwise("error")
    )


def number_or_null(text: Column) -> Column:
    """Text to double; NULL where it is not a number (Java's ``1d`` or ``0x1p3`` are not)."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def clip_seconds(stamp: Column) -> Column:
    """``HH:MM:SS.f`` to seconds, from the last three parts; NULL if there are fewer or one is not a number."""
    parts = F.split(stamp, ":", -1)
    sec, minute, hour = (number_or_null(F.try_element_at(parts, F.lit(i))) for i in (-1, -2, -3))
    return sec + minute * 60.0 + hour * 60.0 * 60.0


def video_url(video_id: Column, drop: int = 0) -> Column:
    """Watch page of a video; ``drop`` skips leading characters of the id (``v_``)."""
    return F.concat(F.lit(fv.VIDEO_URL_PREFIX), F.substring(video_id, drop + 1, 2**31 - 1) if drop else video_id)


def square_pad_box(width: Column, height: Column) -> Column:
    """Side of the square and the offset at which an image is pasted into it."""
    side = F.greatest(width, height)
    return F.struct(
        side.cast("bigint").alias("side"),
        F.floor((side - width) / 2).cast("bigint").alias("x"),
        F.floor((side - height) / 2).cast("bigint").alias("y"),
    )


def frame_indices(key: Column, clip_len: int, rate: int, frames: Column, salt: str = "frames") -> Column:
    """``clip_len`` evenly spaced frame numbers of a window ending at a random frame.

    NULL if the segment is not longer than the window.
    """
    window = int(clip_len * rate)
    last = F.lit(window).cast("bigint") + pick_index(key, salt, F.greatest(frames.cast("bigint") - window, F.lit(1)))
    steps = max(clip_len - 1, 1)

    def spaced(end: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(clip_len - 1)),
            lambda i: F.floor(
                F.least((end - 1).cast("double"), (end - window) + i.cast("double") * (window / steps))
            ).cast("bigint"),
        )

    # a list of one, so that the hash is taken once and not for every frame
    return F.when(frames > window, F.element_at(F.transform(F.array(last), spaced), 1))
