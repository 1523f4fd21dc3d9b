"""Hybrid search: full text and vectors, fused by min-max normalised scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.operators.fts import ranked
from lumenreel.operators.vector import minmax, top_k

#: Scripts without spaces, for which a query counts as long earlier (fixed value).
CJK = "一-鿿㐀-䶿豈-﫿぀-ゟ゠-ヿ가-힯"
WEIGHTS = {"fts": (1.0, 0.0), "vector": (0.0, 1.0), "hybrid": (0.4, 0.6)}


def resolve_weights(query: str, mode: str = "auto", has_embedding: bool = True) -> tuple[float, float]:
    """(full text, vector) weights of a query."""
    if mode in WEIGHTS:
        return WEIGHTS[mode]
    if not has_embedding:
        return 1.0, 0.0
    if '"' in query:
        return 0.9, 0.1
    return (0.2, 0.8) if len(query) > (5 if re.search(f"[{CJK}]", query) else 10) else (0.4, 0.6)


def weight_columns(query: Column, has_embedding: Column) -> tuple[Column, Column]:
    """resolve_weights() in mode auto, for a log of queries."""
    long = F.char_length(query) > F.when(query.rlike(f"[{CJK}]"), 5).otherwise(10)
    fts = F.when(~has_embedding, 1.0).when(F.contains(query, F.lit('"')), 0.9).when(long, 0.2).otherwise(0.4)
    return fts, F.when(~has_embedding, 0.0).when(F.contains(query, F.lit('"')), 0.1).when(long, 0.8).otherwise(0.6)


def fused(texts: DataFrame, vectors: DataFrame, weights: tuple[float, float], k: int, id_column: str) -> DataFrame:
    """(id, rank, similarity, score): the best k of two lists of candidates; what one list lacks counts 0."""
    a = minmax(texts, "rank", "_text", higher_is_better=False, few=True)
    b = minmax(vectors, "similarity", "_vector", few=True)
    both = a.join(b, id_column, "full")
    score = weights[0] * F.coalesce("_text", F.lit(0.0)) + weights[1] * F.coalesce("_vector", F.lit(0.0))
    return both.select(id_column, "rank", "similarity", score.alias("score")).orderBy(F.desc("score"), id_column).limit(k)


def hybrid_search(clips: DataFrame, vectors: DataFrame, query: str, embedding: list[float] | None, mode: str = "auto", k: int = 50, id_column: str = "clip_id", columns: tuple[str, ...] = ("tags_text", "description", "transcript", "user_tags_text"), keep: DataFrame | None = None, text_hits: DataFrame | None = None, **options) -> DataFrame:
    """(id, rank, similarity, score) of the best k clips.

    Filters come first, as `keep`: the ids that may be found, applied to both branches before their best 2k. text_hits, the
    (id, rank) of a stored index, take the place of a search over the clips' texts.
    """
    if keep is not None:
        vectors = vectors.join(keep.select(id_column), id_column, "left_semi")
    text_side = ranked(clips, query, id_column, columns, **options) if text_hits is None else text_hits
    if keep is not None:
        text_side = text_side.join(keep.select(id_column), id_column, "left_semi")
    if mode == "vector":
        found = top_k(vectors, embedding or [], k, id_column) if embedding else top_k(vectors, [], k, id_column, keep_unusable=False)
        return found.select(id_column, F.lit(None).cast("double").alias("rank"), "similarity", F.col("similarity").alias("score"))
    if mode == "fts" or not embedding:
        found = text_side.orderBy("rank", id_column).limit(k)
        return found.select(id_column, "rank", F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("double").alias("score"))
    texts = text_side.orderBy("rank", id_column).limit(2 * k)
    return fused(texts, top_k(vectors, embedding, 2 * k, id_column), resolve_weights(query, mode), k, id_column)


def hydrated(hits: DataFrame, clips: DataFrame, videos: DataFrame | None = None, id_column: str = "clip_id") -> DataFrame:
    """Hits with their clips' columns and, where there is one, the video's."""
    out = hits.join(clips, id_column)
    return out if videos is None else out.join(videos.drop("source_folder"), "video_id", "left")
