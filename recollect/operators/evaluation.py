"""Retrieval metrics over runs (query_id, id, rank) and judgments (query_id, id, gain)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(run: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg, recall, mrr) at k, for every judged query; gain is 2^g - 1."""
    gain = lambda c: F.pow(F.lit(2.0), c) - 1
    w = Window.partitionBy("query_id").orderBy(F.desc("gain"))
    ideal = judged.withColumn("r", F.row_number().over(w)).groupBy("query_id").agg(
        F.sum(F.when(F.col("r") <= k, gain(F.col("gain")) / F.log2(F.col("r") + 1))).alias("best"),
        F.sum((F.col("gain") > 0).cast("int")).alias("relevant"),
    )
    hits = run.where(F.col("rank") <= k).join(judged, ["query_id", "id"]).groupBy("query_id").agg(
        F.sum(gain(F.col("gain")) / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum((F.col("gain") > 0).cast("int")).alias("found"),
        F.min(F.when(F.col("gain") > 0, F.col("rank"))).alias("first"),
    )
    safe = lambda a, b: F.when(b > 0, F.coalesce(a, F.lit(0)) / b).otherwise(F.lit(0.0))
    return ideal.join(hits, "query_id", "left").select(
        "query_id",
        safe(F.col("dcg"), F.col("best")).alias("ndcg"),
        safe(F.col("found"), F.col("relevant")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def bootstrap_interval(values: list[float], rounds: int = 10_000, seed: int = 0, level: float = 0.95) -> tuple[float, float]:
    x, rng = np.asarray(values, float), np.random.default_rng(seed)
    if not len(x):
        return 0.0, 0.0
    means = np.sort([x[rng.integers(0, len(x), len(x))].mean() for _ in range(rounds)])
    tail = (1 - level) / 2
    return float(np.quantile(means, tail)), float(np.quantile(means, 1 - tail))


def paired_test(a: list[float], b: list[float], rounds: int = 10_000, seed: int = 0) -> tuple[float, float]:
    """(mean difference, two-sided sign-flip p)."""
    d, rng = np.asarray(a, float) - np.asarray(b, float), np.random.default_rng(seed)
    if not len(d):
        return 0.0, 1.0
    flips = rng.choice([-1.0, 1.0], (rounds, len(d)))
    return float(d.mean()), float((1 + (np.abs((flips * d).mean(axis=1)) >= abs(d.mean()) - 1e-15).sum()) / (rounds + 1))


def percentile(values: list[float], p: float) -> float:
    return float(np.percentile(values, p)) if values else 0.0
