"""Joins of intervals: transcripts with segments, and positional joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.functions.text import trim


def overlap_join(segments: DataFrame, transcript: DataFrame, key: str = "video_id", bin_width: float | None = None) -> DataFrame:
    """segments (key, seg, start, end) with `text`: the texts of transcript (key, idx, start, end, text) that overlap.

    The joined intervals overlap strictly on both sides. Segments without one have a null text. With bin_width both
    sides are dealt into bins of time, so that a video with very many rows isn't joined in one task; a pair is taken in
    the bin where the later of the two begins.
    """
    t = transcript.select(F.col(key).alias("_k"), F.col("idx").alias("_idx"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("text").alias("_text"))
    on = (F.col(key) == F.col("_k")) & (F.col("_start") < F.col("end")) & (F.col("_end") > F.col("start"))
    left = segments
    if bin_width:
        bins = lambda a, b: F.sequence(F.floor(a / bin_width), F.greatest(F.floor(a / bin_width), F.floor(b / bin_width)))
        left = left.withColumn("_bin", F.explode(bins(F.col("start"), F.col("end"))))
        t = t.withColumn("_tbin", F.explode(bins(F.col("_start"), F.col("_end"))))
        on = on & (F.col("_bin") == F.col("_tbin")) & (F.col("_bin") == F.floor(F.greatest("start", "_start") / bin_width))
    hits = left.join(t, on).groupBy(key, "seg").agg(F.array_sort(F.collect_list(F.struct("_idx", "_text"))).alias("_parts"))
    text = trim(F.array_join(F.transform("_parts", lambda x: x["_text"]), " "))
    hits = hits.select(key, "seg", F.when(text != "", text).alias("text"))
    return segments.join(hits, [key, "seg"], "left")


def positional(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """Rows of the two sides joined by their place within a key."""
    a = left.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(left_order)))
    b = right.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(right_order)))
    return a.join(b, [key, "_i"]).drop("_i")


def renumbered(rows: DataFrame, key: str, order: str, out: str = "idx") -> DataFrame:
    """Rows that aren't blank, numbered from 1."""
    kept = rows.filter(trim(F.col("text")) != "")
    return kept.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(order)))


def timed_runs(rows: DataFrame, key: str) -> DataFrame:
    """Runs with finite times that end after they start and aren't blank, numbered from 1."""
    finite = [~F.isnan(c) & F.col(c).isNotNull() & (F.abs(c) != float("inf")) for c in ("start", "end")]
    return renumbered(rows.filter(finite[0] & finite[1] & (F.col("end") > F.col("start"))), key, "start")
