"""Folders within folders: nearest ancestors, children, and what adding a folder means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.functions.paths import normalized, relationship, under


def ancestors(path: Column) -> Column:
    """All proper prefixes of a normal path, at boundaries of components."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def nearest_parent(paths: DataFrame, registered: DataFrame, path: str = "path", folder: str = "folder") -> DataFrame:
    """(path, parent): the longest registered folder above each path, or null. An equi-join on the path's prefixes."""
    p = paths.select(F.col(path).alias(path), normalized(F.col(path)).alias("_n"))
    each = p.select(path, "_n", F.explode(ancestors(F.col("_n"))).alias("_a"))
    r = registered.select(F.col(folder).alias("_folder"), normalized(F.col(folder)).alias("_a")).distinct()
    found = each.filter("_a <> _n").join(r, "_a").groupBy(path).agg(F.max_by("_folder", F.struct(F.length("_a"), "_folder")).alias("parent"))
    return paths.select(path).distinct().join(found, path, "left")


def children(registered: DataFrame, path: str, folder: str = "folder") -> DataFrame:
    """Registered folders under a path, sorted."""
    return registered.filter(relationship(F.lit(path), F.col(folder)) == "parent").select(folder).orderBy(folder)


def addition_plan(registered: DataFrame, new: str, folder: str = "folder") -> DataFrame:
    """One row (action, parent, children): duplicate, bookmark under the nearest parent, parent of some, or normal."""
    related = registered.select(F.col(folder).alias("f"), relationship(F.lit(new), F.col(folder)).alias("r"))
    found = related.agg(
        F.coalesce(F.bool_or(F.col("r") == "duplicate"), F.lit(False)).alias("dup"),
        F.max_by(F.when(F.col("r") == "child", F.col("f")), F.when(F.col("r") == "child", F.length(normalized(F.col("f"))))).alias("parent"),
        F.array_sort(F.collect_list(F.when(F.col("r") == "parent", F.col("f")))).alias("children"),
    )
    action = F.when(F.col("dup"), "duplicate").when(F.col("parent").isNotNull(), "bookmark").when(F.size("children") > 0, "add_as_parent").otherwise("normal")
    out = found.withColumn("action", action)
    return out.select("action", F.when(F.col("action") == "bookmark", F.col("parent")).alias("parent"), F.when(F.col("action") == "add_as_parent", F.col("children")).otherwise(F.array().cast("array<string>")).alias("children"))


def without_children(videos: DataFrame, folders: DataFrame, path: str = "file_path", folder: str = "folder") -> DataFrame:
    """Videos that lie under none of the folders: an anti-join on each path's prefixes, whatever the folders' number."""
    keyed = videos.withColumn("_row", F.monotonically_increasing_id())
    each = keyed.select("_row", F.explode(ancestors(F.col(path))).alias("_a"))
    hit = each.join(folders.select(normalized(F.col(folder)).alias("_a")).distinct(), "_a", "left_semi").select("_row").distinct()
    return keyed.join(hit, "_row", "left_anti").drop("_row")


def under_mount(folders: DataFrame, mount: str, folder: str = "folder_path") -> DataFrame:
    """Folders that a vanished mount takes along."""
    return folders.filter(under(F.col(folder), F.lit(mount)))


def remounted_folders(offline: DataFrame, mounted: DataFrame) -> DataFrame:
    """Offline folders (folder_path, volume_uuid) with the mount point (mount) where their volume is now."""
    from lumenreel.functions.paths import remounted

    return offline.join(mounted.select("volume_uuid", "mount"), "volume_uuid").withColumn("new_path", remounted(F.col("folder_path"), F.col("mount")))
