"""Facets, tags, folder statistics, votes and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.functions.text import distinct_tags
from lumenreel.schema import COLORS

def count() -> Column:
    return F.count(F.lit(1))



def facet(rows: DataFrame, column: str, limit: int | None = 20) -> DataFrame:
    """(value, n) of a column's non-empty values, most frequent first."""
    found = rows.filter((F.col(column).isNotNull()) & (F.col(column).cast("string") != "")).groupBy(F.col(column).cast("string").alias("value")).agg(count().alias("n"))
    found = found.orderBy(F.desc("n"), "value")
    return found if limit is None else found.limit(limit)


def all_facets(rows: DataFrame, folders: list[str] | None = None, limit: int = 20, colors: tuple[str, ...] = tuple(COLORS)) -> DataFrame:
    """(dimension, value, n) of shot type, mood, rating and colour, in one pass over rows.

    Unlike for a search, an empty list of folders is no filter here.
    """
    from pyspark.sql import Window

    if folders:
        rows = rows.filter(F.col("source_folder").isin(*folders))
    parts = [("shot_type", F.when(F.col("shot_type") != "", F.col("shot_type"))), ("mood", F.when(F.col("mood") != "", F.col("mood"))), ("rating", F.when(F.col("rating") > 0, F.col("rating").cast("string"))), ("color_label", F.when(F.col("color_label").isin(*colors), F.col("color_label")))]
    each = rows.select(F.explode(F.filter(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in parts]), lambda x: x["value"].isNotNull())).alias("f"))
    counts = each.groupBy("f.dimension", "f.value").agg(count().alias("n"))
    best = Window.partitionBy("dimension").orderBy(F.desc("n"), "value")
    limited = counts.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= F.when(F.col("dimension").isin("shot_type", "mood"), limit).otherwise(2**31 - 1))
    return limited.drop("r")


def popular_tags(rows: DataFrame, *columns: str | Column, limit: int = 30) -> DataFrame:
    """(tag, n): tags by the number of rows that have them."""
    tags = distinct_tags(*[F.col(c) if isinstance(c, str) else c for c in columns])
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(count().alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def tag_suggestions(popular: DataFrame, current: list[str], limit: int = 12) -> DataFrame:
    return popular.filter(~F.col("tag").isin(*current) if current else F.lit(True)).orderBy(F.desc("n"), "tag").limit(limit)


def folder_stats(rows: DataFrame, folder: str = "source_folder", video: str = "video_id") -> DataFrame:
    """(folder, n_videos, n_clips)."""
    return rows.groupBy(folder).agg(F.count_distinct(video).alias("n_videos"), count().alias("n_clips"))


def majority_vote(votes: DataFrame, key: str, value: str, confidence: str) -> DataFrame:
    """(key, value, confidence): the value with most votes; ties by the best confidence, then by value."""
    counts = votes.groupBy(key, value).agg(count().alias("n"), F.max(confidence).alias("best"))
    won = F.max_by(F.struct(F.col(value), F.col("best")), F.struct("n", "best", F.col(value)))
    return counts.groupBy(key).agg(won.alias("w")).select(key, F.col(f"w.{value}").alias(value), F.col("w.best").alias(confidence))


def most_frequent(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the modal value; ties go to the least value."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(count().alias("n"))
    return counts.groupBy(key).agg(F.min_by(F.col(value), F.struct(-F.col("n"), F.col(value))).alias(value))


def collapsed_frames(frames: DataFrame, clip: str = "clip_id", frame: str = "frame", most_objects: int = 10) -> DataFrame:
    """One row for each clip from its frames: modal strings, ordered unions of lists, the first colours."""
    out = frames.select(clip).distinct()
    for c in ("scene", "shot_type", "lighting"):
        out = out.join(most_frequent(frames, clip, c), clip, "left")

    def gathered(c: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(frame, F.coalesce(F.col(c), F.array().cast("array<string>")).alias("v")))), lambda x: x["v"])))

    lists = frames.groupBy(clip).agg(gathered("subjects").alias("subjects"), F.slice(gathered("objects"), 1, most_objects).alias("objects"), F.min_by("colors", F.when(F.col("colors").isNotNull(), F.col(frame))).alias("colors"))
    return out.join(lists, clip)


def run_summary(results: DataFrame) -> DataFrame:
    """One row of counters over (ok, clips_created, clips_analyzed)."""
    return results.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.coalesce(F.sum("clips_created"), F.lit(0)).alias("clips"), F.coalesce(F.sum("clips_analyzed"), F.lit(0)).alias("analyzed"))


def recent(rows: DataFrame, id_column: str = "id", limit: int = 20) -> DataFrame:
    return rows.orderBy(F.desc(id_column)).limit(limit)
