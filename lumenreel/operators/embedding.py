"""Embedding providers: a protocol, its batched application to a column, and an offline provider."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EmbeddingProvider(Protocol):
    """What makes vectors of texts. Instances travel to the workers, so they must be picklable."""

    name: str
    dimensions: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashingProvider:
    """Signed counts of hashed words, of length 1. Deterministic; needs no model and no network."""

    def __init__(self, dimensions: int = 64):
        self.name, self.dimensions = f"hashing-{dimensions}", dimensions
        self.known: dict[str, tuple[int, int]] = {}

    def place(self, word: str) -> tuple[int, int]:
        """The dimension and the sign of a word, from the first 8 digits of its MD5."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= 100_000:
                self.known.clear()
            h = int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16)
            self.known[word] = found = (h % self.dimensions, 1 if h >> 31 else -1)
        return found

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                at, sign = self.place(word)
                row[at] += sign
        lengths = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, lengths, out=out, where=lengths > 0).tolist()


def embedded(provider: EmbeddingProvider, text: Column, batch: int = 100) -> Column:
    """The provider's vector of each text, asked for in batches; null and blank texts: null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = pd.Series([None] * len(texts), dtype=object)
            asked = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            for at in range(0, len(asked), batch):
                some = asked[at : at + batch]
                for i, vector in zip(some, provider.embed_batch([texts.iloc[j] for j in some]), strict=True):
                    out.iat[i] = vector
            yield out

    return run(text)


def fill_embeddings(clips: DataFrame, provider: EmbeddingProvider, text: Column) -> DataFrame:
    """Clips with vectors of this provider's model where there was none or another model's."""
    stale = F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(provider.name))
    done = clips.filter(~stale)
    fresh = clips.filter(stale).withColumn("embedding", embedded(provider, text)).withColumn("embedding_model", F.when(F.col("embedding").isNotNull(), provider.name))
    return done.unionByName(fresh)


def text_embeddings(texts: DataFrame, words: DataFrame, key: str, text: str, word: str = "word", vector: str = "embedding") -> DataFrame:
    """(key, embedding): the mean of the vectors of a text's known words; keys without one are left out."""
    from lumenreel.operators.vector import centroids

    each = texts.select(key, F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias(word))
    return centroids(each.join(words, word), key, vector)
