"""Non-redundancy over ranked pools: greedy Jaccard dedup and maximal marginal relevance.

Both walk a ranking in order, so they are array folds over one query's bounded pool.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import jaccard, words_by_space
from lodestone.sources.cut import cut

THRESHOLD, MAX_RESULTS, MMR_POOL, LAMBDA = 0.65, 10, 20, 0.7
#: Entries of a ranking that are looked at first; the pool doubles while it proves too small.
FIRST_POOL = 64


def _deduplicated(ranking: DataFrame, texts: DataFrame, pool: int, most: int, threshold: float) -> DataFrame:
    rows = ranking.where(F.col("rank") <= pool).join(texts, "chunk_id").select("query_id", F.struct("rank", "chunk_id", "score", F.array_distinct(words_by_space(F.col("fmt"))).alias("words")).alias("x"))
    pools = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("pool"))

    def step(kept, x):
        close = F.exists(kept, lambda y: jaccard(y["words"], x["words"]) >= threshold)
        return F.when((F.size(kept) >= most) | close, kept).otherwise(F.concat(kept, F.array(x)))

    return pools.select("query_id", F.size("pool").alias("seen"), F.aggregate("pool", F.slice("pool", 1, 0), step).alias("kept"))


def dedup(ranking: DataFrame | Callable[[int], DataFrame], texts: DataFrame, most: int = MAX_RESULTS, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, chunk_id, score, rank): the first ``most`` entries unlike all accepted before.

    texts: (chunk_id, fmt). ranking: whole, or a function that gives it to some depth. The
    pool of a query grows until it yields enough entries or the ranking ends, so nothing is
    cut short.
    """
    pool = FIRST_POOL
    whole = None if callable(ranking) else cut(ranking)
    while True:
        found = cut(_deduplicated(ranking(pool) if whole is None else whole, texts, pool, most, threshold))
        if found.where((F.size("kept") < most) & (F.col("seen") >= pool)).isEmpty():
            break
        pool *= 2
    return found.select("query_id", F.posexplode("kept").alias("pos", "x")).select("query_id", "x.chunk_id", "x.score", (F.col("pos") + 1).alias("rank"))


def mmr(ranking: DataFrame, vectors: DataFrame, top_k: int = 5, weight: float = LAMBDA) -> DataFrame:
    """(query_id, chunk_id, score, rank): weight * relevance - (1 - weight) * closest picked.

    Relevance is the min-max score over the pool of the first 4 * top_k (all 1 if flat);
    similarity the cosine of vectors (chunk_id, term, w) of length 1; ties go to the
    earlier entry.
    """
    pool = ranking.where(F.col("rank") <= 4 * top_k)
    per_query = Window.partitionBy("query_id")
    low, high = F.min("score").over(per_query), F.max("score").over(per_query)
    rel = pool.withColumn("rel", F.when(high - low > 0, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0)))
    sparse = pool.select("query_id", "chunk_id").join(vectors, "chunk_id")
    pairs = sparse.alias("a").join(sparse.alias("b"), ["query_id", "term"]).where("a.chunk_id < b.chunk_id").groupBy("query_id", F.col("a.chunk_id").alias("a"), F.col("b.chunk_id").alias("b")).agg(F.sum(F.col("a.w") * F.col("b.w")).alias("sim"))
    both = pairs.unionByName(pairs.select("query_id", F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    empty = F.array().cast("array<struct<b:bigint,sim:double>>")
    sims = both.groupBy("query_id", F.col("a").alias("chunk_id")).agg(F.collect_list(F.struct("b", F.round("sim", 9).alias("sim"))).alias("sims"))
    rows = rel.join(sims, ["query_id", "chunk_id"], "left").select("query_id", F.struct("rank", "chunk_id", "score", F.round("rel", 9).alias("rel"), F.coalesce("sims", empty).alias("sims")).alias("x"))
    pools = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("pool"))

    def value(picked, x):
        closest = F.coalesce(F.array_max(F.transform(F.filter(x["sims"], lambda e: F.array_contains(picked, e["b"])), lambda e: e["sim"])), F.lit(0.0))
        # entries without a shared term have similarity 0; before the first pick relevance decides
        return F.when(F.size(picked) == 0, x["rel"]).otherwise(F.round(weight * x["rel"] - (1 - weight) * closest, 9))

    def step(picked, _):
        left = F.filter(F.col("pool"), lambda x: ~F.array_contains(picked, x["chunk_id"]))
        scored = F.transform(left, lambda x: F.struct(value(picked, x).alias("v"), (-x["rank"]).alias("n"), x["chunk_id"].alias("id")))
        return F.when(F.size(left) > 0, F.concat(picked, F.array(F.array_max(scored)["id"]))).otherwise(picked)

    picks = pools.select("query_id", "pool", F.aggregate(F.sequence(F.lit(1), F.lit(top_k)), F.array().cast("array<bigint>"), step).alias("picked"))
    out = picks.select("query_id", "pool", F.posexplode("picked").alias("pos", "chunk_id"))
    score = F.filter("pool", lambda x: x["chunk_id"] == F.col("chunk_id"))[0]["score"]
    return out.select("query_id", "chunk_id", score.alias("score"), (F.col("pos") + 1).alias("rank"))


def rerank(ranking: DataFrame, pool_scores: DataFrame, pool: int = 50) -> DataFrame:
    """(query_id, chunk_id, score, rank): the first ``pool`` entries by pool_scores, then the rest."""
    head = ranking.where(F.col("rank") <= pool).drop("score").join(pool_scores, ["query_id", "chunk_id"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    top = head.withColumn("new", F.row_number().over(order)).select("query_id", "chunk_id", "score", F.col("new").alias("rank"))
    return top.unionByName(ranking.where(F.col("rank") > pool).select("query_id", "chunk_id", F.lit(0.0).alias("score"), "rank"))
