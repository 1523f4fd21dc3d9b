"""Time segments: denoising cuts, segments between cuts, merging short and splitting long ones, sampling.

Each works on an array column of one video, so a video's sequence is a fold inside its row and nothing is shuffled
beyond what gathers the cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.functions.enrich import frames_per_scene

SEGMENTS = "array<struct<start:double,end:double>>"
#: Defaults: least gap of cuts, least and most length of a segment, length of parts, length that counts as none.
MIN_GAP, MIN_LENGTH, MAX_LENGTH, PART, NONE = 0.3, 2.0, 30.0, 15.0, 0.01


def segment(start: Column, end: Column) -> Column:
    return F.struct(start.cast("double").alias("start"), end.cast("double").alias("end"))


def denoised(cuts: Column, min_gap: float = MIN_GAP) -> Column:
    """Sorted cuts, each at least min_gap after the last one kept."""
    empty = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(cuts), empty, lambda kept, x: F.when((F.size(kept) == 0) | (x - F.try_element_at(kept, F.lit(-1)) >= min_gap), F.concat(kept, F.array(x))).otherwise(kept))


def between(cuts: Column, duration: Column) -> Column:
    """Segments between sorted cuts; the first and the last only if longer than 0.01 s; without cuts one."""
    first, last = F.get(cuts, 0), F.try_element_at(cuts, F.lit(-1))
    none = F.array().cast(SEGMENTS)
    inner = F.transform(F.filter(cuts, lambda x, i: i > 0), lambda x, i: segment(F.get(cuts, i), x))
    parts = F.concat(F.when(first > NONE, F.array(segment(F.lit(0.0), first))).otherwise(none), inner, F.when(duration - last > NONE, F.array(segment(last, duration))).otherwise(none))
    return F.when(F.size(cuts) == 0, F.array(segment(F.lit(0.0), duration))).otherwise(parts)


def merged(segments: Column, min_length: float = MIN_LENGTH) -> Column:
    """While a segment is too short it takes in the next one."""

    def step(done: Column, x: Column) -> Column:
        open_ = F.try_element_at(done, F.lit(-1))
        short = (F.size(done) > 0) & (open_["end"] - open_["start"] < min_length)
        return F.when(short, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(segment(open_["start"], x["end"])))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(segments, F.array().cast(SEGMENTS), step)


def split(segments: Column, max_length: float = MAX_LENGTH, part: float = PART) -> Column:
    """Segments that are too long in parts; a rest of less than half a part belongs to the part before it."""

    def parts(s: Column) -> Column:
        n = F.greatest(F.lit(1), F.floor((s["end"] - s["start"]) / part + 0.5).cast("int"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: segment(s["start"] + i * part, F.when(i == n - 1, s["end"]).otherwise(s["start"] + (i + 1) * part)))

    return F.flatten(F.transform(segments, lambda s: F.when(s["end"] - s["start"] <= max_length, F.array(segment(s["start"], s["end"]))).otherwise(parts(s))))


def segmented(cuts: Column, duration: Column, min_gap: float = MIN_GAP, min_length: float = MIN_LENGTH, max_length: float = MAX_LENGTH, part: float = PART) -> Column:
    """All four steps. For a table of rows use segment_table(), which names each step's result."""
    return split(merged(between(denoised(cuts, min_gap), duration), min_length), max_length, part)


def segment_table(videos: DataFrame, cuts: str = "cuts", duration: str = "duration", out: str = "segments", min_gap: float = MIN_GAP, min_length: float = MIN_LENGTH, max_length: float = MAX_LENGTH, part: float = PART) -> DataFrame:
    """videos with their segments; steps are columns, so that none is made anew inside another's fold."""
    held = videos.withColumn("_c", denoised(F.col(cuts), min_gap)).withColumn("_b", between(F.col("_c"), F.col(duration)))
    return held.withColumn("_m", merged(F.col("_b"), min_length)).withColumn(out, split(F.col("_m"), max_length, part)).drop("_c", "_b", "_m")


def frame_times(start: Column, end: Column, n: Column | None = None) -> Column:
    """Middles of equal parts of a segment."""
    n = frames_per_scene(end - start) if n is None else n
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + (end - start) / n * (i + 0.5))


def sample_ranges(segments: Column, most: int = 3, length: float = 30.0) -> Column:
    """Ranges to listen to: not the first segment, evenly spread; of one segment its second half."""
    content = F.filter(segments, lambda s, i: i > 0)
    step = F.greatest(F.lit(1), F.floor(F.size(content) / most).cast("int"))
    ranged = F.transform(content, lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), F.least(s["start"] + length, s["end"]).alias("end")))
    chosen = F.slice(F.filter(ranged, lambda s: (s["i"] % step == 0) & (s["end"] > s["start"])), 1, most)
    only = F.get(segments, 0)
    middle = only["start"] + (only["end"] - only["start"]) / 2
    alone = F.array(segment(middle, F.least(middle + length, only["end"])))
    several = F.transform(chosen, lambda s: segment(s["start"], s["end"]))
    return F.when(F.size(segments) == 0, F.array().cast(SEGMENTS)).when(F.size(segments) == 1, alone).otherwise(several)
