"""Change events: classifying, deduplicating and routing, in batches and as a stream; debouncing and rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.functions.paths import is_video


def classify(exists: Column, created: Column, renamed: Column, changed: Column, removed: Column) -> Column:
    """added, modified, removed, or null for an event that says nothing."""
    gone = F.when(created | renamed | changed | removed, "removed")
    return F.when(~exists, gone).when(created | renamed, "added").otherwise("modified")


def relevant(events: DataFrame) -> DataFrame:
    """Events on video files outside of the index's own folders; overflow events stay."""
    own = F.contains(F.col("path"), F.lit("/.clip-index"))
    return events.filter((F.col("kind") == "rescan") | (is_video(F.col("path")) & ~own & F.col("kind").isNotNull()))


def deduplicated(events: DataFrame, path: str = "path", kind: str = "kind", seq: str = "seq") -> DataFrame:
    """(path, kind, seq): of each path the last kind, at the place of its first event."""
    return events.groupBy(path).agg(F.max_by(kind, seq).alias(kind), F.min(seq).alias(seq))


def routed(events: DataFrame, retention_days: int = 30) -> DataFrame:
    """events with `route`: a folder's rescan swallows the rest; removals are soft with a retention, else hard."""
    rescan = F.max((F.col("kind") == "rescan").cast("int")).over(Window.partitionBy("folder")) == 1
    route = F.when(rescan, "rescan").when(F.col("kind") == "removed", "orphan" if retention_days > 0 else "delete").otherwise("index")
    return events.withColumn("route", route)


def debounced(events: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """Events that no other of the same key follows within the gap."""
    following = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, "event_id"))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return events.withColumn("_next", following).filter(F.col("_next").isNull() | (seconds(F.col("_next")) - seconds(F.col(ts)) > gap_seconds)).drop("_next")


def sliding_rate(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """events with `in_window`: how many of the key lie in the seconds up to each, itself included."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    window = Window.partitionBy(key).orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("_at", at).withColumn("in_window", F.count(F.lit(1)).over(window)).drop("_at")


def daily_count(events: DataFrame, key: str, ts: str) -> DataFrame:
    """events with `day` and `in_day`: how many of the key there are on that day up to each, itself included."""
    day = F.to_date(F.col(ts))
    window = Window.partitionBy(key, "day").orderBy(ts).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("day", day).withColumn("in_day", F.count(F.lit(1)).over(window))


def health_changes(folders: DataFrame, reachable: DataFrame) -> DataFrame:
    """(folder_path, is_available) of folders that have vanished or come back since is_available was noted.

    For a check at an interval, call it in each micro-batch of a stream with that trigger.
    """
    now = reachable.select("folder_path").distinct().withColumn("_now", F.lit(True))
    both = folders.join(now, "folder_path", "left").withColumn("_now", F.coalesce("_now", F.lit(False)))
    return both.filter(F.col("_now") != F.coalesce("is_available", F.lit(False))).select("folder_path", F.col("_now").alias("is_available"))


def next_limit(limit: Column, throttled: Column, least: int = 3, most: int = 10) -> Column:
    """The request limit after an answer: down by 2 when throttled, up by 1 else."""
    return F.when(throttled, F.greatest(F.lit(least), limit - 2)).otherwise(F.least(F.lit(most), limit + 1))


def back_off(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt))


def deferred(events: DataFrame, busy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events to handle now, and those of folders that are being indexed, to replay later."""
    return events.join(busy.select("folder"), "folder", "left_anti"), events.join(busy.select("folder"), "folder", "left_semi")


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, retention_days: int = 30):
    """Start a query that deduplicates and routes each micro-batch and hands it on; it ends when all input is read."""

    def batch(rows: DataFrame, number: int) -> None:
        handle(routed(deduplicated_with_folder(relevant(rows)), retention_days), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated_with_folder(events: DataFrame) -> DataFrame:
    return events.groupBy("folder", "path").agg(F.max_by("kind", "seq").alias("kind"), F.min("seq").alias("seq"))


def windowed_counts(stream: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and kind with a watermark; works on streams and tables."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")
