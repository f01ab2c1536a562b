"""Fusing ranked lists: by reciprocal rank, or by scores scaled to [0, 1]."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.lexical import top

RRF_K = 60


def _stack(arms: list[tuple[DataFrame, float]]) -> DataFrame:
    used = [a.select("query_id", "id", F.col("score").cast("double").alias("score"), "rank", F.lit(float(w)).alias("w"), F.lit(i).alias("arm")) for i, (a, w) in enumerate(arms) if w]
    return reduce(DataFrame.unionByName, used)


def reciprocal_rank(arms: list[tuple[DataFrame, float]], k: int) -> DataFrame:
    """Sum of weight / (60 + rank); an arm of weight 0 is left out."""
    fused = _stack(arms).groupBy("query_id", "id").agg(F.sum(F.col("w") / (RRF_K + F.col("rank"))).alias("score"))
    return top(fused, k)


def scaled_scores(arms: list[tuple[DataFrame, float]], k: int) -> DataFrame:
    """Weighted sum of min-max scaled scores; an arm without spread counts 1."""
    w = Window.partitionBy("query_id", "arm")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    s = F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(F.lit(1.0))
    fused = _stack(arms).withColumn("s", s).groupBy("query_id", "id").agg(F.sum(F.col("s") * F.col("w")).alias("score"))
    return top(fused, k)


def fuse(arms: list[tuple[DataFrame, float]], k: int, mode: str = "rrf") -> DataFrame:
    if mode == "rrf":
        return reciprocal_rank(arms, k)
    if mode == "dbsf":
        return scaled_scores(arms, k)
    raise ValueError(f"unknown fusion mode {mode!r}")
