"""A small invented library for demonstrations and tests: four recordings of a railway trip with nine clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenreel.schema import CLIPS, VIDEOS

#: File name, seconds, bytes.
FILES = (("platform_rain.mov", 41.5, 9_300_000), ("dining_car.mp4", 66.0, 14_100_000), ("viaduct.mkv", 95.25, 21_750_000), ("ferry_harbour.webm", 58.0, 12_400_000))
#: The number of the file, start, end, scene, description, tags, what is said, rating.
SHOTS = (
    (1, 0.0, 17.0, "station", "Rain drips from the station roof onto an empty platform", "rain platform grey", None, 2),
    (1, 17.0, 41.5, "departure", "A conductor closes the last door and raises a green disc", "conductor platform door", "Zurückbleiben bitte", 4),
    (2, 0.0, 22.5, "dining car", "Soup plates tremble on a white tablecloth", "soup table interior", "is this seat taken", 3),
    (2, 22.5, 66.0, "kitchen", "La cuisinière découpe des poireaux près de la fenêtre", "cuisine légumes interior", None, 0),
    (3, 0.0, 31.0, "valley", "The train leans into a curve high above a gorge", "viaduct mountain aerial", None, 5),
    (3, 31.0, 60.0, "tunnel", "Lamps flick past in a long tunnel", "tunnel dark", "hold on tight", 1),
    (3, 60.0, 95.25, "lake", "Nebel liegt über dem See, ein Boot treibt am Ufer", "lake fog boat", None, 3),
    (4, 0.0, 25.0, "harbour", "Ferry ropes splash into the harbour water", "ferry harbour rope", "cast off forward", 4),
    (4, 25.0, 58.0, "deck", "Gulls follow the ferry past a lighthouse", "ferry gulls lighthouse", None, 0),
)


def library(spark: SparkSession, folder: str = "/library") -> tuple[DataFrame, DataFrame]:
    """(videos, clips) of the demonstration library."""
    videos = [{"video_id": i, "source_folder": folder, "source_video_id": i, "file_path": f"{folder}/{name}", "file_name": name, "duration": seconds, "file_size": size} for i, (name, seconds, size) in enumerate(FILES, 1)]
    clips = [{"clip_id": i, "source_folder": folder, "source_clip_id": i, "video_id": v, "start_time": a, "end_time": b, "scene": scene, "description": text, "tags": tags.split(), "transcript": said, "rating": stars} for i, (v, a, b, scene, text, tags, said, stars) in enumerate(SHOTS, 1)]
    full = lambda rows, schema: spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
    return full(videos, VIDEOS), full(clips, CLIPS)
