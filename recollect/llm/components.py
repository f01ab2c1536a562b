"""Connected components of an edge table by alternating star contractions.

Each round links every node's larger neighbours to its smallest one (large
star), then its smaller neighbours (small star). Rounds are cut by reliable
checkpoints and stop when the edges no longer change; their number grows with
the logarithm of the longest path, the data of a round is linear in the edges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.runtime import cut


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) edges that connect what the pairs (positions into ids) connect."""
    parent = np.arange(len(ids))
    while len(a):
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        if (before == parent).all():
            break
    moved = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[moved], ids[parent[moved]]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("u"), F.col("v")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(low, "u")
    if large:
        linked = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return linked.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the least node of its component.

    Self-loops and null ends are ignored, repeated edges count once.
    """
    at = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    at = cut(at)
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = print_of(at)
    while seen[0]:
        at = cut(_star(_star(at, True), False))
        now = print_of(at)
        if now == seen:
            break
        seen = now
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
