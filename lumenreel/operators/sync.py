"""Incremental synchronisation of folder tables into global ones, upserts, removal, moves, tags and labels.

Tables are immutable: each function returns the new state. Callers write it to a new version or by partitions of
source_folder; nothing overwrites what it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.functions.enrich import color_or_null, rating
from lumenreel.functions.paths import rebased
from lumenreel.functions.text import NO_STRINGS, trim
from lumenreel.operators.hierarchy import without_children


def after(rows: DataFrame, cursor: int, id_column: str, limit: int | None = None) -> DataFrame:
    """Rows with an id above the cursor; with a limit, the first of them in order (a page)."""
    found = rows.filter(F.col(id_column) > cursor)
    return found if limit is None else found.orderBy(id_column).limit(limit)


def new_cursor(rows: DataFrame, cursor: int, id_column: str) -> DataFrame:
    """One row: the highest id that was scanned, skipped rows included."""
    return rows.agg(F.greatest(F.coalesce(F.max(id_column), F.lit(cursor)), F.lit(cursor)).cast("long").alias("cursor"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """old with the rows of new in place of those with the same keys; of several new rows the last by order stays."""
    if order is not None:
        new = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).filter("_r = 1").drop("_r")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def importable(videos: DataFrame, global_videos: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """Videos that may enter: not under a registered child folder, and not at a path that another folder owns."""
    if children is not None:
        videos = without_children(videos, children)
    owners = global_videos.select("file_path", F.col("source_folder").alias("_owner"))
    return videos.join(owners, (videos["file_path"] == owners["file_path"]) & (videos["source_folder"] != owners["_owner"]), "left_anti")


def importable_clips(clips: DataFrame, videos: DataFrame, global_videos: DataFrame) -> DataFrame:
    """Clips of importable videos, with the video's global id. Exclusion is judged on the full table of videos."""
    kept = clips.join(videos.select("source_folder", "source_video_id"), ["source_folder", "source_video_id"], "left_semi")
    ids = global_videos.select("source_folder", "source_video_id", "video_id")
    return kept.drop("video_id").join(ids, ["source_folder", "source_video_id"], "left")


def sync_folder(folder: str, videos: DataFrame, clips: DataFrame, global_videos: DataFrame, global_clips: DataFrame, meta: DataFrame, now: Column, children: DataFrame | None = None, force: bool = False) -> dict[str, DataFrame]:
    """The new global videos, clips and meta after a folder's rows past its cursors are taken in.

    videos and clips have source_folder and source_video_id (clips: source_clip_id too); a video's global id is the hash
    of its natural key, so it is the same on every run.
    """
    last = meta.filter(F.col("folder_path") == folder).select("last_synced_video_rowid", "last_synced_clip_rowid").first()
    v0, c0 = (0, 0) if force or last is None else (last[0] or 0, last[1] or 0)
    allowed = importable(videos, global_videos, children)
    key = F.xxhash64("source_folder", "source_video_id")
    fresh = after(allowed, v0, "source_video_id").withColumn("video_id", key)
    new_videos = upsert(global_videos, fresh, ["source_folder", "source_video_id"])
    rows = importable_clips(after(clips, c0, "source_clip_id"), allowed, new_videos)
    new_clips = upsert(global_clips, rows.withColumn("clip_id", F.xxhash64("source_folder", "source_clip_id")), ["source_folder", "source_clip_id"])
    cursors = new_cursor(videos, v0, "source_video_id").select(F.col("cursor").alias("last_synced_video_rowid")).crossJoin(new_cursor(clips, c0, "source_clip_id").select(F.col("cursor").alias("last_synced_clip_rowid")))  # one row each
    row = cursors.select(F.lit(folder).alias("folder_path"), "last_synced_clip_rowid", "last_synced_video_rowid", now.alias("last_synced_at"), F.lit(None).cast("string").alias("volume_uuid"), F.lit(None).cast("string").alias("volume_name"))
    return {"videos": new_videos, "clips": new_clips, "meta": upsert_meta(meta, row), "synced_videos": fresh, "synced_clips": rows}


def counters(synced: dict[str, DataFrame]) -> DataFrame:
    """One row: how many videos and clips sync_folder() took in."""
    n = F.count(F.lit(1))
    return synced["synced_videos"].agg(n.alias("videos")).join(F.broadcast(synced["synced_clips"].agg(n.alias("clips"))))  # one row each


def upsert_meta(meta: DataFrame, new: DataFrame) -> DataFrame:
    """sync_meta with new rows; their null volume columns keep the old values."""
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns])
    both = meta.join(n, F.col("folder_path") == F.col("_n_folder_path"), "full")
    out = []
    for c in meta.columns:
        fresh = F.col(f"_n_{c}")
        out.append((F.coalesce(fresh, F.col(c)) if c in ("folder_path", "volume_uuid", "volume_name") else F.when(F.col("_n_folder_path").isNotNull(), fresh).otherwise(F.col(c))).alias(c))
    return both.select(*out)


def volume_of(folders: DataFrame, folder: str) -> DataFrame:
    """One row: the volume columns of the folder's row, else of the first row."""
    order = F.struct((F.col("folder_path") != folder).cast("int"), "id")
    return folders.agg(F.min_by("volume_uuid", order).alias("volume_uuid"), F.min_by("volume_name", order).alias("volume_name"))


def without_folder(rows: DataFrame, folder: str, column: str = "source_folder") -> DataFrame:
    return rows.filter(F.col(column) != folder)


def rekeyed(rows: DataFrame, old: str, new: str, column: str = "source_folder") -> DataFrame:
    return rows.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))


def rebase(rows: DataFrame, columns: list[str], old: str, new: str) -> DataFrame:
    """rows with the prefix of path columns replaced, and `changed`: whether any was."""
    changed = F.lit(False)
    for c in columns:
        changed = changed | F.coalesce(rebased(F.col(c), old, new) != F.col(c), F.lit(False))
    return rows.withColumn("changed", changed).withColumns({c: rebased(F.col(c), old, new) for c in columns})


def clean_tags(tags: Column) -> Column:
    """Trimmed and not empty, in order; null if none is left."""
    kept = F.filter(F.transform(tags, trim), lambda x: x != "")
    return F.when(F.size(kept) > 0, kept)


def tags_added(tags: Column, more: Column) -> Column:
    none = F.array().cast(NO_STRINGS)
    found = F.array_distinct(F.concat(F.coalesce(tags, none), F.coalesce(clean_tags(more), none)))
    return F.when(F.size(found) > 0, found)


def tags_removed(tags: Column, gone: Column) -> Column:
    kept = F.filter(tags, lambda x: ~F.array_contains(gone, x))
    return F.when(F.size(kept) > 0, kept)


def labelled(clips: DataFrame, updates: DataFrame) -> DataFrame:
    """Clips after a log of updates (clip_id, seq, rating, color_label, sets_rating, sets_color); the last one counts."""
    last = updates.groupBy("clip_id").agg(
        F.max_by(F.when(F.col("sets_rating"), F.struct(rating(F.col("rating")).alias("v"))), F.when(F.col("sets_rating"), F.col("seq"))).alias("_r"),
        F.max_by(F.when(F.col("sets_color"), F.struct(color_or_null(F.col("color_label")).alias("v"))), F.when(F.col("sets_color"), F.col("seq"))).alias("_c"),
    )
    both = clips.join(last, "clip_id", "left")
    both = both.withColumn("rating", F.when(F.col("_r").isNotNull(), F.col("_r.v")).otherwise(rating(F.col("rating"))))
    return both.withColumn("color_label", F.when(F.col("_c").isNotNull(), F.col("_c.v")).otherwise(F.col("color_label"))).drop("_r", "_c")


def latest_color(clips: DataFrame, key: str = "video_id", id_column: str = "clip_id", color: str = "color_label") -> DataFrame:
    """(key, color): of the highest id that has one."""
    return clips.filter(F.col(color).isNotNull()).groupBy(key).agg(F.max_by(color, id_column).alias(color))


def patched(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with columns replaced where changes has a value."""
    new = changes.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    both = rows.join(new, key, "left")
    return both.withColumns({c: F.coalesce(f"_n_{c}", c) for c in columns}).drop(*[f"_n_{c}" for c in columns])


def folder_listing(meta: DataFrame, stats: DataFrame, available: DataFrame) -> DataFrame:
    """Folders by path with their statistics and whether they are mounted."""
    out = meta.join(stats.withColumnRenamed("source_folder", "folder_path"), "folder_path", "left").na.fill(0, ["n_videos", "n_clips"])
    return out.join(available.select("folder_path", "is_available"), "folder_path", "left").withColumn("is_available", F.coalesce("is_available", F.lit(False))).orderBy("folder_path")
