"""Models as providers: what turns texts into vectors, scores pairs of texts, or ranks tokens. The ones here are deterministic and need no weights.

An encoder has dimension and encode(list of texts) -> rows of numbers; a reranker has score(list of (text, text)) -> numbers. A provider
is pickled to the workers and used batch by batch, so one that loads weights should do so on first use.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


class Encoder(Protocol):
    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


@functools.lru_cache(1 << 18)
def _place(word: str, dimension: int) -> tuple[int, int]:
    digest = hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()
    return int(digest[:4], 16) % dimension, 1 if digest[4] < "8" else -1


class HashEncoder:
    """Signed counts of words by a hash of each word (the first four hexadecimal digits of its MD5 name the place, the fifth the sign), of unit length.
    Texts with much the same words have cosines near 1. A text without words is the zero vector."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, t in zip(out, texts):
            for w in words(t):
                at, sign = _place(w, self.dimension)
                row[at] += sign
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


class OverlapReranker:
    """Share of the words of either text that both have."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for a, b in pairs:
            x, y = set(words(a)), set(words(b))
            out.append(len(x & y) / len(x | y) if x | y else 0.0)
        return out


def vectors(text: Column, encoder: Encoder, batch: int = 16) -> Column:
    """The text's vector; null for null."""

    @F.pandas_udf("array<double>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = []
            texts = s.fillna("").tolist()
            for a in range(0, len(texts), batch):
                out += list(np.asarray(encoder.encode(texts[a : a + batch]), np.float64))
            yield pd.Series([v if known else None for v, known in zip(out, s.notna())], index=s.index, dtype=object)

    return encode(text)


def pair_scores(a: Column, b: Column, reranker: Reranker) -> Column:
    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series(reranker.score(list(zip(x.fillna(""), y.fillna("")))), index=x.index, dtype="float64")

    return score(a, b)


def reranked(candidates: DataFrame, keys: list[str], query: str, content: str, rank: str, reranker: Reranker) -> DataFrame:
    """(keys, score, content, rank) of each query's best candidate by the pair score, the first on ties."""
    scored = candidates.withColumn("_s", pair_scores(F.col(query), F.col(content), reranker))
    best = F.max_by(F.struct(F.col("_s").alias("score"), F.col(content).alias("content"), F.col(rank).alias("rank")), F.struct("_s", -F.col(rank)))
    return scored.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
