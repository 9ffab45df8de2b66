"""Fusion of rankings: normalised, linear, adaptive and reciprocal-rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import INTERROGATIVES, words_by_space

RRF_K = 60


def min_max(scores: DataFrame) -> DataFrame:
    """Scores scaled to [0, 1] per query; all 0.5 where they hardly differ."""
    per_query = Window.partitionBy("query_id")
    low, high = F.min("score").over(per_query), F.max("score").over(per_query)
    spread = high - low
    return scores.select("query_id", "chunk_id", F.when(spread < 1e-9, F.lit(0.5)).otherwise((F.col("score") - low) / (spread + 1e-9)).alias("score"))


def adaptive_alpha(query_text: Column) -> Column:
    """0.7 for questions of more than four tokens, else 0.3."""
    tokens = words_by_space(query_text)
    asks = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in INTERROGATIVES]))
    return F.when(F.size(tokens) <= 4, F.lit(0.3)).when(asks, F.lit(0.7)).otherwise(F.lit(0.3))


def linear(dense: DataFrame, sparse: DataFrame, alpha: Column | float) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse of min-max scores over one universe.

    A Column alpha may use ``alpha`` of either side, one value a query.
    """
    d, s = min_max(dense).withColumnRenamed("score", "d"), min_max(sparse).withColumnRenamed("score", "s")
    weight = F.lit(alpha) if isinstance(alpha, float) else alpha
    return d.join(s, ["query_id", "chunk_id"]).select("query_id", "chunk_id", (weight * F.col("d") + (1 - weight) * F.col("s")).alias("score"))


def adaptive(dense: DataFrame, sparse: DataFrame, queries: DataFrame) -> DataFrame:
    """Linear fusion with each query's own alpha."""
    alphas = queries.select("query_id", adaptive_alpha(F.col("query_text")).alias("alpha"))
    d, s = min_max(dense).withColumnRenamed("score", "d"), min_max(sparse).withColumnRenamed("score", "s")
    return d.join(s, ["query_id", "chunk_id"]).join(alphas, "query_id").select("query_id", "chunk_id", (F.col("alpha") * F.col("d") + (1 - F.col("alpha")) * F.col("s")).alias("score"))


def rrf(rankings: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """Sum of weight / (k + rank) per chunk, with the ranks kept as r0, r1, ... for ties.

    One union and one aggregate, however many lists there are.
    """
    weights = weights or [1.0] * len(rankings)
    parts = [r.select("query_id", "chunk_id", F.lit(i).alias("list"), "rank", F.lit(float(w)).alias("weight")) for i, (r, w) in enumerate(zip(rankings, weights, strict=True))]
    ranks = [F.min(F.when(F.col("list") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(rankings))]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), *ranks)


def ranked_by_fusion(fused: DataFrame, top_k: int | None = None, digits: int = 12) -> DataFrame:
    """(query_id, chunk_id, score, rank): by fused score, then the rank in each list, then id."""
    lists = [c for c in fused.columns if c[0] == "r" and c[1:].isdigit()]
    rounded = fused.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *[F.col(c).asc_nulls_last() for c in lists], "chunk_id")
    out = rounded.withColumn("rank", F.row_number().over(order)).select("query_id", "chunk_id", "score", "rank")
    return out.where(F.col("rank") <= top_k) if top_k else out
