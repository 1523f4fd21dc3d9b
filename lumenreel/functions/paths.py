"""Paths: normal forms, relationships, prefixes and moves from one place to another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenreel.schema import VIDEO_EXTENSIONS


def normalized(path: Column) -> Column:
    """Without slashes at the end; a root stays."""
    return F.when(path.rlike("^/+$"), "/").otherwise(F.regexp_replace(path, "/+$", ""))


def last_component(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_video(path: Column) -> Column:
    return F.lower(F.substring_index(last_component(path), ".", -1)).isin(*VIDEO_EXTENSIONS) & F.contains(last_component(path), F.lit("."))


def under(path: Column, mount: Column) -> Column:
    """Whether path is mount or lies under it; all absolute paths lie under the root."""
    p, m = normalized(path), normalized(mount)
    return F.when(m == "/", F.startswith(p, F.lit("/"))).otherwise((p == m) | F.startswith(p, F.concat(m, F.lit("/"))))


def relationship(a: Column, b: Column) -> Column:
    """What a is to b: duplicate, parent, child or unrelated."""
    x, y = normalized(a), normalized(b)
    return F.when(x == y, "duplicate").when(F.startswith(y, F.concat(x, F.lit("/"))), "parent").when(F.startswith(x, F.concat(y, F.lit("/"))), "child").otherwise("unrelated")


def rebased(path: Column, old: str, new: str) -> Column:
    """path with the prefix old replaced by new, at a boundary of components; others and nulls as they are."""
    old, new = old.rstrip("/"), new.rstrip("/")
    return F.when((path == old) | F.startswith(path, F.lit(old + "/")), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)


def mount_point(path: Column) -> Column:
    """/Volumes/X of a path on a volume, else the root."""
    found = F.regexp_extract(path, "^(/Volumes/[^/]+)", 1)
    return F.when(found != "", found).otherwise("/")


def remounted(path: Column, mount: Column) -> Column:
    """The path's place under another mount point."""
    rest = F.when(mount_point(path) == "/", path).otherwise(F.substr(path, F.length(mount_point(path)) + 1))
    return F.when(mount == "/", rest).otherwise(F.concat(mount, rest))
