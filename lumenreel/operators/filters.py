"""Filters of clips and of results, and sorting of results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folder_filter(rows: DataFrame, folders: list[str] | None, column: str = "source_folder") -> DataFrame:
    """None: all rows; an empty list: none; else the rows of these folders."""
    if folders is None:
        return rows
    return rows.filter(F.col(column).isin(*sorted(folders))) if folders else rows.filter(F.lit(False))


def prefix_filter(rows: DataFrame, prefix: str | None, column: str = "file_path", strict: bool = True) -> DataFrame:
    """Rows under a path prefix. strict: at a boundary and with case; else like a LIKE pattern."""
    if prefix is None:
        return rows
    return rows.filter(F.startswith(F.col(column), F.lit(prefix + "/")) if strict else F.col(column).ilike(prefix + "/%"))


def lookup(rows: DataFrame, column: str, value) -> DataFrame:
    """At most one row: one that has the value."""
    return rows.filter(F.col(column) == F.lit(value)).limit(1)


def with_status(rows: DataFrame, *statuses: str, column: str = "index_status", other: bool = False) -> DataFrame:
    """Rows of these statuses, or of any other."""
    found = F.col(column).isin(*statuses)
    return rows.filter(~found if other else found)


def ordered(rows: DataFrame, *order, limit: int | None = None) -> DataFrame:
    """Rows in order, or the first of them."""
    found = rows.orderBy(*order)
    return found if limit is None else found.limit(limit)


def union_ids(*parts: DataFrame, id_column: str = "clip_id") -> DataFrame:
    """Each id that is in any part, once."""
    out = parts[0].select(id_column)
    for part in parts[1:]:
        out = out.union(part.select(id_column))
    return out.distinct()


@dataclass(frozen=True)
class ResultFilter:
    """What a result must fulfil; empty parts don't constrain. Applied after the best K unless asked otherwise."""

    min_rating: int | None = None
    colors: frozenset[str] = field(default_factory=frozenset)
    shot_types: frozenset[str] = field(default_factory=frozenset)
    moods: frozenset[str] = field(default_factory=frozenset)

    @property
    def active(self) -> int:
        return sum((bool(self.min_rating and self.min_rating > 0), bool(self.colors), bool(self.shot_types), bool(self.moods)))

    @property
    def is_empty(self) -> bool:
        return not self.active

    def apply(self, rows: DataFrame) -> DataFrame:
        if self.min_rating and self.min_rating > 0:
            rows = rows.filter(F.col("rating") >= self.min_rating)
        for column, values in (("color_label", self.colors), ("shot_type", self.shot_types), ("mood", self.moods)):
            if values:
                rows = rows.filter(F.col(column).isin(*sorted(values)))
        return rows


def sorted_results(rows: DataFrame, by: str = "relevance", ascending: bool = True, id_column: str = "clip_id") -> DataFrame:
    """Results by date (start time), duration or rating; relevance keeps the order. Ties by id."""
    if by == "relevance":
        return rows
    key = {"date": F.col("start_time"), "duration": F.col("end_time") - F.col("start_time"), "rating": F.col("rating")}[by]
    return rows.orderBy(key.asc() if ascending else key.desc(), id_column)
