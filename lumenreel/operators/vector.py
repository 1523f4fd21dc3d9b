"""Exact vector search: cosine similarity and the best K."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors that are empty, of other lengths or without length."""
    down = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (down > 0), dot(a, b) / down).otherwise(F.lit(0.0))


def cosine_to(query: list[float]):
    """A vectorised function: the cosine similarity of each vector of a column with `query`."""
    q = np.asarray(query, np.float64)
    length = float(np.sqrt(q @ q)) if len(q) else 0.0

    @F.pandas_udf(T.DoubleType())
    def similarity(vectors: pd.Series) -> pd.Series:
        fits = vectors.map(lambda v: v is not None and len(v) == len(q) and len(q) > 0).to_numpy(bool)
        out = np.zeros(len(vectors))
        if fits.any() and length > 0:
            rows = np.stack(vectors[fits].to_numpy()).astype(np.float64)
            norms = np.sqrt((rows * rows).sum(axis=1))
            out[fits] = np.divide(rows @ q, norms * length, out=np.zeros(len(rows)), where=norms > 0)
        return pd.Series(out)

    return similarity


def top_k(vectors: DataFrame, query: list[float], k: int, id_column: str = "clip_id", vector_column: str = "embedding", keep_unusable: bool = True) -> DataFrame:
    """(id, similarity) of the nearest k; ties by id. Unusable vectors have similarity 0, or are left out."""
    rows = vectors
    if not keep_unusable:
        if not query or not math.sqrt(sum(x * x for x in query)):
            return vectors.select(id_column, F.lit(0.0).alias("similarity")).limit(0)
        rows = loaded(vectors, len(query), vector_column)
    scored = rows.select(id_column, cosine_to(query)(F.col(vector_column)).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), id_column).limit(k)


def loaded(vectors: DataFrame, size: int, vector_column: str = "embedding") -> DataFrame:
    """Vectors of the right size that aren't all zero, with their norm."""
    return vectors.filter(F.size(vector_column) == size).withColumn("norm", norm(F.col(vector_column))).filter("norm > 0")


def allowed(vectors: DataFrame, ids: DataFrame, id_column: str = "clip_id") -> DataFrame:
    """Only vectors whose id is in ids; to be done before the best K are taken."""
    return vectors.join(ids.select(id_column), id_column, "left_semi")


def upserted(vectors: DataFrame, changes: DataFrame, id_column: str = "clip_id", order: str | None = None) -> DataFrame:
    """Vectors with those of changes in place of the old ones. Of several changes of an id the last by `order` counts, else the
    one whose vector is greatest, so that the result is one row for each id."""
    last = Window.partitionBy(id_column).orderBy(*([F.desc(order)] if order else [F.desc(c) for c in changes.columns if c != id_column]))
    changes = changes.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
    return vectors.join(changes.select(id_column), id_column, "left_anti").unionByName(changes)


def removed(vectors: DataFrame, ids: DataFrame, id_column: str = "clip_id") -> DataFrame:
    return vectors.join(ids.select(id_column), id_column, "left_anti")


def centroids(words: DataFrame, key: str, vector_column: str = "embedding") -> DataFrame:
    """The mean vector of each key; null where no vector is known."""
    each = words.select(key, F.posexplode(vector_column).alias("place", "x"))
    means = each.groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias(vector_column))


def minmax(rows: DataFrame, column: str, out: str, higher_is_better: bool = True, few: bool = False) -> DataFrame:
    """rows with `out`: column scaled to 0 to 1; all equal, or one row: 0. The extremes are one broadcast row.

    `few` says that rows are a list of best hits: they are in one place already, so one window spares a second run.
    """
    value = F.col(column) if higher_is_better else -F.col(column)
    if few:
        all_rows = Window.partitionBy(F.lit(0))
        held = rows.withColumn("_lo", F.min(value).over(all_rows)).withColumn("_hi", F.max(value).over(all_rows))
        return held.withColumn(out, F.when(F.col("_hi") > F.col("_lo"), (value - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))).drop("_lo", "_hi")
    extremes = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (value - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    return rows.join(F.broadcast(extremes)).withColumn(out, scaled).drop("_lo", "_hi")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to vectors; bytes after the last whole number are ignored."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4").tolist())


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
