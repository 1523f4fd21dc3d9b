"""Command line: `python -m lumenreel <command> --root FOLDER ...`.

init         make the tables of a library, empty
insert-mock  add the demonstration library
index        record the video files of --folder, and put the clips' texts into the stored full-text index
sync         take the tables of --folder into those of --root, past what was taken in before (--force: all)
search       search clips by text, vector or both; by the stored index if there is one
facets       count clips by shot type, mood, rating and colour
segments     print the segments of a tool log's cuts
embed        give vectors to clips that lack them
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.functions.paths import last_component
from lumenreel.functions.text import compose_text, timecode
from lumenreel.operators import embedding, facets, search, segments, sync
from lumenreel.sources import files, mock, text_index


def versioned(spark: SparkSession, root: str, name: str, rows: DataFrame) -> None:
    """Put rows in place of a table: a new folder first, then a swap of names; nothing overwrites what it reads."""
    new = f"{root}/.{name}-{uuid.uuid4().hex}"
    rows.write.parquet(new)
    moved(spark, new, f"{root}/{name}")


def moved(spark: SparkSession, new: str, at: str) -> None:
    """Put a folder in place of another."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs, old = path(at).getFileSystem(spark._jsc.hadoopConfiguration()), f"{at}.old-{uuid.uuid4().hex}"
    if fs.exists(path(at)):
        fs.rename(path(at), path(old))
    fs.rename(path(new), path(at))
    fs.delete(path(old), True)


def searchable(clips: DataFrame) -> DataFrame:
    """Clips with their tags as text."""
    return clips.withColumn("tags_text", F.array_join("tags", " ")).withColumn("user_tags_text", F.array_join("user_tags", " "))


TEXT_COLUMNS = ("tags_text", "description", "transcript", "user_tags_text")


def clip_index(spark: SparkSession, root: str) -> text_index.TextIndex:
    return text_index.TextIndex(spark, f"{root}/text_index", "clip_id", TEXT_COLUMNS, "source_folder")


def indexed(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """Record a folder's video files that aren't known yet, index the clips' texts, and give all that are recorded of it."""
    videos = files.open_table(spark, root, "videos")
    scan = files.scan_videos(spark, folder)
    # ids that rise, as a later sync goes by what is past its cursor
    last = videos.agg(F.coalesce(F.max("source_video_id"), F.lit(0))).first()[0]
    new = scan.join(videos.select("file_path"), "file_path", "left_anti")
    hashes = files.hashed_files(spark, folder)
    rows = new.join(hashes, "file_path", "left").withColumn("source_video_id", F.monotonically_increasing_id() + last + 1)
    rows = rows.select(F.xxhash64(F.lit(folder), "source_video_id").alias("video_id"), F.lit(folder).alias("source_folder"), "source_video_id", "file_path", last_component(F.col("file_path")).alias("file_name"), F.col("size").alias("file_size"), "file_hash")
    versioned(spark, root, "videos", videos.unionByName(rows, allowMissingColumns=True))
    index = clip_index(spark, root)
    index.build(searchable(files.open_table(spark, root, "clips")))
    index.discard()
    return files.open_table(spark, root, "videos").filter(F.col("source_folder") == folder)


def synced(spark: SparkSession, root: str, folder: str, force: bool = False) -> dict[str, int]:
    """Take a folder's tables into those of root; the counts of what was taken in."""
    old = {n: files.open_table(spark, root, n) for n in ("videos", "clips", "sync_meta")}
    own = {n: files.open_table(spark, folder, n) for n in ("videos", "clips")}
    children = old["sync_meta"].filter(F.col("folder_path") != folder).select(F.col("folder_path").alias("folder"))
    children = children.filter(F.startswith("folder", F.lit(folder.rstrip("/") + "/")))
    clips = own["clips"].join(own["videos"].select("source_folder", F.col("video_id"), "source_video_id"), ["source_folder", "video_id"], "left")
    known = old["clips"].join(old["videos"].select("source_folder", "video_id", "source_video_id"), ["source_folder", "video_id"], "left")
    out = sync.sync_folder(folder, own["videos"], clips, old["videos"], known, old["sync_meta"], F.current_timestamp(), children, force)
    counts = sync.counters(out).first()
    for name, rows in (("videos", out["videos"]), ("clips", out["clips"].drop("source_video_id")), ("sync_meta", out["meta"])):
        versioned(spark, root, f"{name}.next", rows.select(old[name].columns))
    for name in ("videos", "clips", "sync_meta"):  # all are written before the first is put in place
        moved(spark, f"{root}/{name}.next", f"{root}/{name}")
    return {"videos": counts["videos"], "clips": counts["clips"]}


def found(spark: SparkSession, root: str, query: str, mode: str, k: int) -> DataFrame:
    """Hits with times and files, best first."""
    clips, videos = files.open_table(spark, root, "clips"), files.open_table(spark, root, "videos")
    provider = embedding.HashingProvider()
    vector = None if mode == "fts" else provider.embed_batch([query])[0]
    vectors = clips.filter(F.col("embedding_model") == provider.name).select("clip_id", "embedding")
    if vector is not None and vectors.isEmpty():
        vector, mode = None, "fts"
    index = clip_index(spark, root)
    hits = search.hybrid_search(searchable(clips), vectors, query, vector, mode, k, text_hits=index.search(query, 2 * k) if index.exists() else None)
    names = videos.select("video_id", "file_name", "source_folder")
    out = search.hydrated(hits, clips.select("clip_id", "video_id", "start_time", "end_time", "scene"), names)
    order = [F.desc("score"), "clip_id"] if vector is not None else ["rank", "clip_id"]
    return out.orderBy(*order).select("clip_id", "file_name", timecode(F.col("start_time")).alias("from"), timecode(F.col("end_time")).alias("to"), "scene", "rank", "similarity", "score")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lumenreel", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["init", "insert-mock", "index", "sync", "search", "facets", "segments", "embed"])
    parser.add_argument("--root", required=True)
    parser.add_argument("--query", default="")
    parser.add_argument("--mode", choices=["auto", "fts", "vector", "hybrid"], default="auto")
    parser.add_argument("--limit", type=int, default=20)
    parser.add_argument("--folder", help="a folder of videos, or of a library's tables")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--log", help="a tool's log, for segments")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "init":
        for name in files.TABLES:
            files.open_table(spark, args.root, name)
    elif args.command == "insert-mock":
        for name, rows in zip(("videos", "clips"), mock.library(spark, args.root), strict=True):
            files.append(rows, args.root, name)
    elif args.command == "index":
        indexed(spark, args.root, args.folder or args.root).select("file_name", "file_size", "file_hash").show(1000, False)
    elif args.command == "sync":
        print(synced(spark, args.root, args.folder, args.force))
    elif args.command == "search":
        found(spark, args.root, args.query, args.mode, args.limit).show(args.limit, False)
        row = [(uuid.uuid4().int >> 65, args.query)]
        history = spark.createDataFrame(row, "id long, query string").select("id", "query", F.current_timestamp().alias("searched_at"), F.lit(None).cast("int").alias("result_count"))
        files.append(history, args.root, "search_history")
    elif args.command == "facets":
        facets.all_facets(files.open_table(spark, args.root, "clips")).orderBy("dimension", F.desc("n")).show(100, False)
    elif args.command == "segments":
        log = spark.read.text(args.log, wholetext=True)
        cuts = log.select(files.log_cuts(F.col("value")).alias("cuts"), files.log_duration(F.col("value")).alias("duration"))
        segments.segment_table(cuts).select(F.explode("segments").alias("s")).select("s.start", "s.end").show(1000, False)
    elif args.command == "embed":
        clips = files.open_table(spark, args.root, "clips")
        text = compose_text({f: F.col(f) for f in ("scene", "description", "subjects", "actions", "objects", "mood", "shot_type", "lighting", "colors")}, F.col("transcript"))
        versioned(spark, args.root, "clips", embedding.fill_embeddings(clips, embedding.HashingProvider(), text))


if __name__ == "__main__":
    main()
