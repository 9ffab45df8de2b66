"""Encoders and pair scorers as pluggable Arrow functions.

No model is available offline. ``hashing_encoder`` and ``overlap_scorer`` are deterministic
stand-ins with the same interface, named for what they are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64


def hashing_encoder(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed hashed word counts of length 1: a stand-in for a sentence encoder."""
    import zlib

    out = np.zeros((len(texts), dimensions))
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            out[i, h % dimensions] += 1 if h & 0x80000000 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def overlap_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """Share of a query's words that a passage has: a stand-in for a cross-encoder."""
    out = []
    for query, passage in pairs:
        words = set(query.lower().split())
        out.append(len(words & set(passage.lower().split())) / max(1, len(words)))
    return out


def encode(df: DataFrame, column: str, encoder: Callable[[list[str]], np.ndarray] = hashing_encoder, prefix: str = "") -> DataFrame:
    """df with ``vector``: the encoded text column, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encoder([prefix + (t or "") for t in texts])))

    return df.withColumn("vector", run(column))


def pair_scores(pool: DataFrame, queries: DataFrame, chunks: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]] = overlap_scorer) -> DataFrame:
    """(query_id, chunk_id, score) of the pool's query-passage pairs."""

    @F.pandas_udf("double")
    def run(q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(scorer(list(zip(q, c, strict=True))))

    joined = pool.select("query_id", "chunk_id").join(queries, "query_id").join(chunks.select("chunk_id", "fmt"), "chunk_id")
    return joined.select("query_id", "chunk_id", F.round(run("query_text", "fmt"), 9).alias("score"))
