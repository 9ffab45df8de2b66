"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import written

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b); component: the smallest id reachable.

    Alternates two star operations until nothing changes: every node hands its larger
    neighbours to its smallest one, then its smaller neighbours to its smallest. A hub's
    neighbours are only ever aggregated or joined, so a hub stays spread over tasks; the
    rounds grow with the logarithm of the longest chain.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "links")
    raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")


def spanning_tree(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of a bipartite graph."""
    rows, cols = near.shape
    seen_r, seen_c, out = np.zeros(rows, dtype=bool), np.zeros(cols, dtype=bool), []
    for start in np.flatnonzero(near.any(1)):
        if seen_r[start]:
            continue
        seen_r[start] = True
        front = np.array([start])
        while len(front):
            new_c = np.flatnonzero(near[front].any(0) & ~seen_c)
            if not len(new_c):
                break
            out += zip(front[np.argmax(near[np.ix_(front, new_c)], axis=0)].tolist(), new_c.tolist(), strict=True)
            seen_c[new_c] = True
            new_r = np.flatnonzero(near[:, new_c].any(1) & ~seen_r)
            out += zip(new_r.tolist(), new_c[np.argmax(near[np.ix_(new_r, new_c)], axis=1)].tolist(), strict=True)
            seen_r[new_r] = True
            front = new_r
    return out
