"""The life of a video's index: registering, skipping, orphans, recovery and cleaning up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def register(videos: DataFrame, found: DataFrame) -> DataFrame:
    """videos and a pending row for each new path."""
    new = found.join(videos.select("file_path"), "file_path", "left_anti").dropDuplicates(["file_path"])
    return videos.unionByName(new.withColumn("index_status", F.lit("pending")), allowMissingColumns=True)


def with_status(videos: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """videos after updates (video_id, status, error); indexed_at is set only on completion."""
    both = videos.join(updates.select("video_id", "status", "error"), "video_id", "left")
    new = F.col("status").isNotNull()
    both = both.withColumn("indexed_at", F.when(F.col("status") == "completed", now).otherwise(F.col("indexed_at")))
    return both.withColumn("index_error", F.when(new, F.col("error")).otherwise(F.col("index_error"))).withColumn("index_status", F.coalesce("status", "index_status")).drop("status", "error")


def needs_hash(status: Column, size: Column, mtime: Column, old_size: Column, old_mtime: Column, old_hash: Column) -> Column:
    """Whether the content must be hashed to decide: only then is the file read."""
    same = size.eqNullSafe(old_size) & mtime.eqNullSafe(old_mtime)
    return ((status == "completed") & ~same) | ((status == "orphaned") & old_hash.isNotNull())


def decision(status: Column, size: Column, mtime: Column, new_hash: Column, old_size: Column, old_mtime: Column, old_hash: Column) -> Column:
    """What to do with a scanned file: skip, refresh (times changed only), backfill (its hash), recover or index."""
    same = size.eqNullSafe(old_size) & mtime.eqNullSafe(old_mtime)
    done = F.when(same, "skip").when(old_hash.isNotNull(), F.when(new_hash.eqNullSafe(old_hash), "refresh").otherwise("index"))
    done = done.when(size.isNotNull() & old_size.isNotNull() & (size != old_size), "index").otherwise("backfill")
    orphan = F.when(old_hash.isNotNull() & new_hash.eqNullSafe(old_hash), "recover").otherwise("index")
    return F.when(status == "completed", done).when(status == "orphaned", orphan).otherwise("index")


def decided(scan: DataFrame, videos: DataFrame, hashes) -> DataFrame:
    """scan (file_path, size, mtime) with `action`. hashes(df) adds new_hash; it gets only rows that need it."""
    old = videos.select("file_path", "index_status", F.col("file_size").alias("_s"), F.col("file_modified").alias("_m"), F.col("file_hash").alias("_h"))
    both = scan.join(old, "file_path", "left").withColumn("index_status", F.coalesce("index_status", F.lit("pending")))
    args = [F.col(c) for c in ("index_status", "size", "mtime")]
    ask = needs_hash(*args, F.col("_s"), F.col("_m"), F.col("_h"))
    rows = hashes(both.filter(ask)).unionByName(both.filter(~ask).withColumn("new_hash", F.lit(None).cast("string")))
    return rows.withColumn("action", decision(*args, F.col("new_hash"), F.col("_s"), F.col("_m"), F.col("_h"))).drop("_s", "_m", "_h")


def newest_orphans(videos: DataFrame, key: str = "file_hash", at: str = "orphaned_at", id_column: str = "video_id") -> DataFrame:
    """The newest orphan of each hash; ties go to the highest id."""
    newest = Window.partitionBy(key).orderBy(F.desc(at), F.desc(id_column))
    orphans = videos.filter((F.col("index_status") == "orphaned") & F.col(key).isNotNull())
    return orphans.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def recovered(videos: DataFrame, arrivals: DataFrame) -> DataFrame:
    """videos after arrivals (file_path, file_hash): the newest orphan of a hash takes the path of one arrival.

    Pending rows of the arrivals that were matched go; clips stay with the orphan's id.
    """
    first = Window.partitionBy("file_hash").orderBy("file_path")
    one = arrivals.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("file_hash", F.col("file_path").alias("_new"))
    match = newest_orphans(videos).join(one, "file_hash").select("video_id", "_new")
    rest = videos.join(match.select(F.col("_new").alias("file_path")), "file_path", "left_anti")
    both = rest.join(match, "video_id", "left")
    hit = F.col("_new").isNotNull()
    both = both.withColumn("file_path", F.coalesce("_new", "file_path")).withColumn("index_status", F.when(hit, "completed").otherwise(F.col("index_status")))
    return both.withColumn("orphaned_at", F.when(~hit, F.col("orphaned_at"))).drop("_new")


def orphaned(videos: DataFrame, removed: DataFrame, now: Column) -> DataFrame:
    """videos with those at removed paths marked."""
    hit = removed.select("file_path").distinct().withColumn("_hit", F.lit(True))
    both = videos.join(hit, "file_path", "left")
    return both.withColumn("index_status", F.when(F.col("_hit"), "orphaned").otherwise(F.col("index_status"))).withColumn("orphaned_at", F.when(F.col("_hit"), now).otherwise(F.col("orphaned_at"))).drop("_hit")


def expired(videos: DataFrame, now: Column, retention_days: int) -> DataFrame:
    """Orphans past their retention; a retention of 0 or less keeps all."""
    if retention_days <= 0:
        return videos.limit(0)
    return videos.filter((F.col("index_status") == "orphaned") & (F.col("orphaned_at") < now - F.expr(f"INTERVAL {retention_days} DAYS")))


def without(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """rows less those whose keys are in gone: deletes videos, and their clips."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def unprocessed(clips: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Clips past the last one processed of their video."""
    return clips.join(checkpoints.select("video_id", "last_processed_clip"), "video_id", "left").filter(F.col("clip_id") > F.coalesce("last_processed_clip", F.lit(0))).drop("last_processed_clip")
