"""Schemas of the engine's tables and the registry of descriptive fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: File extensions, colours with Finder numbers, statuses with their order.
VIDEO_EXTENSIONS = ("mp4", "mov", "mkv", "avi", "mxf", "webm", "m4v", "ts", "mts")
COLORS = {"red": 6, "orange": 7, "yellow": 5, "green": 2, "blue": 4, "purple": 3, "gray": 1}
STATUS_ORDER = {"pending": 0, "stt_running": 1, "stt_done": 2, "vision_running": 3, "completed": 4, "failed": -1, "orphaned": -2}


def _struct(text: str) -> T.StructType:
    """A schema from `name type, ...`; a type that ends in ! isn't nullable."""
    fields = [x.strip().rsplit(" ", 1) for x in text.split(",")]
    return T.StructType([T.StructField(n.strip(), _TYPES[t.rstrip("!")], not t.endswith("!")) for n, t in fields])


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType()), "floats": T.ArrayType(T.FloatType())}

CLIPS = _struct(
    "clip_id long!, source_folder string!, source_clip_id long!, video_id long, start_time double!, end_time double!, thumbnail_path string, "
    "scene string, subjects strings, actions strings, objects strings, mood string, shot_type string, lighting string, colors string, "
    "description string, tags strings, user_tags strings, transcript string, embedding floats, embedding_model string, rating int, color_label string"
)
VIDEOS = _struct("video_id long!, source_folder string!, source_video_id long!, file_path string!, file_name string!, duration double, file_size long, file_hash string, srt_path string")
SYNC_META = _struct("folder_path string!, last_synced_clip_rowid long, last_synced_video_rowid long, last_synced_at timestamp, volume_uuid string, volume_name string")
SEARCH_HISTORY = _struct("id long!, query string!, searched_at timestamp!, result_count int")


@dataclass(frozen=True)
class Field:
    """A descriptive field: its column, whether it is a list, whether it feeds tags, its group and how sources merge."""

    name: str
    is_array: bool
    in_tags: bool
    group: str


FIELDS = (
    Field("scene", False, True, "primary"),
    Field("subjects", True, True, "detail"),
    Field("actions", True, True, "detail"),
    Field("objects", True, True, "detail"),
    Field("mood", False, True, "meta"),
    Field("shot_type", False, True, "meta"),
    Field("lighting", False, True, "meta"),
    Field("colors", False, True, "meta"),
    Field("description", False, False, "primary"),
)
#: How the texts of a group are joined, in this order.
GROUPS = {"primary": ". ", "detail": ", ", "meta": ", "}
