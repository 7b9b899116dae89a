"""What a model must offer to stand behind the engine, and models that need no network."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.operators import distill
from loomstead.operators.embedding import hashed_vector


@runtime_checkable
class Embedder(Protocol):
    """Texts to vectors of unit length."""

    model_name: str
    dimensions: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


@runtime_checkable
class Reranker(Protocol):
    """How well each passage answers a query, larger is better; scores of one pair don't depend on the others."""

    model_name: str

    def score(self, query: str, passages: Sequence[str]) -> Sequence[float]: ...


@runtime_checkable
class Distiller(Protocol):
    """Units of dialogues to summaries, as a column of structs."""

    model_name: str

    def distil(self, units: DataFrame) -> DataFrame: ...


class HashingEmbedder:
    model_name = "hashing"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        return np.stack([hashed_vector(t, self.dimensions) for t in texts]) if len(texts) else np.zeros((0, self.dimensions), np.float32)


class OverlapReranker:
    """The share of the query's words that stand in a passage."""

    model_name = "overlap"

    def score(self, query: str, passages: Sequence[str]) -> list[float]:
        words = sorted(set(query.lower().split()))
        return [sum(w in p.lower() for w in words) / len(words) if words else 0.0 for p in passages]


class ExtractiveDistiller:
    model_name = "extractive"

    def distil(self, units: DataFrame) -> DataFrame:
        return distill.extract(units)


def embedded(text: Column, model: Embedder) -> Column:
    """Vectors of a column, made in Arrow batches; null stays null."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        known = texts.notna()
        out = pd.Series([None] * len(texts), dtype=object)
        out[known.to_numpy()] = pd.Series([v.tolist() for v in model.embed(texts[known].tolist())], index=out.index[known.to_numpy()], dtype=object)
        return out

    return run(text)


def in_batches(lengths: Sequence[int], size: int) -> Iterator[list[int]]:
    """Places of items in batches of like length, so that none is padded to the longest of all."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    for at in range(0, len(order), size):
        yield order[at : at + size]


def reranked(query: Column, passage: Column, model: Reranker, size: int = 8) -> Column:
    """Scores of (query, passage) rows, asked in batches of one query and like lengths; null scores null."""

    @F.pandas_udf("double")
    def run(queries: pd.Series, passages: pd.Series) -> pd.Series:
        out = np.full(len(queries), np.nan)
        known = (queries.notna() & passages.notna()).to_numpy()
        for q in dict.fromkeys(queries[known]):
            own = np.flatnonzero(known & (queries == q).to_numpy())
            texts = passages.iloc[own].tolist()
            for batch in in_batches([len(t) for t in texts], size):
                out[own[batch]] = model.score(q, [texts[i] for i in batch])
        return pd.Series(out).where(pd.Series(known), None)

    return run(query, passage)
