"""What usually comes next in a context: decayed distributions, surprise and drift.

Observations (context, shape, seq). The weight of each is 1/0.999 of the one
before it (one clock for all contexts), so shares are those of a decayed count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROWTH, RECENT, EPSILON, ALERT = math.log(1 / 0.999), 128, 1e-4, 0.25
SURE, SEEN, FORGOTTEN = 0.97, 30, 1e-6


def _share(w: Column, total: Column) -> Column:
    """NaN where all of a context has faded to 0, so that it has no likeliest shape by its weights."""
    return F.when(total > 0, F.try_divide(w, total)).otherwise(F.lit(float("nan")))


def distribution(obs: DataFrame) -> DataFrame:
    """(context, shape, n, share)."""
    last = obs.agg(F.max("seq").alias("last"))
    w = obs.crossJoin(last).groupBy("context", "shape").agg(F.count("*").alias("n"), F.sum(F.exp((F.col("seq") - F.col("last")) * GROWTH)).alias("w"))
    total = w.groupBy("context").agg(F.sum("w").alias("t"))
    return w.join(total, "context").select("context", "shape", "n", _share(F.col("w"), F.col("t")).alias("share"))


def merge(known: DataFrame, obs: DataFrame) -> DataFrame:
    """A snapshot (context, shape, n, w, last) brought up to new observations (context, shape, seq).

    ``w`` is the decayed count as of ``last``, the largest seq so far; one clock for all contexts.
    """
    fresh = obs.groupBy("context", "shape", "seq").agg(F.count("*").alias("n"))
    both = known.select("context", "shape", "n", "w", F.col("last").alias("at")).unionByName(fresh.select("context", "shape", "n", F.col("n").cast("double").alias("w"), F.col("seq").alias("at")))
    last = both.agg(F.max("at").alias("last"))
    faded = F.col("w") * F.exp((F.col("at") - F.col("last")) * GROWTH)
    return both.crossJoin(last).groupBy("context", "shape", "last").agg(F.sum("n").cast("bigint").alias("n"), F.sum(faded).alias("w")).select("context", "shape", "n", "w", "last")


def restored(snapshot: DataFrame) -> DataFrame:
    """(context, shape, n, share) of a snapshot, as ``distribution`` gives it."""
    total = snapshot.groupBy("context").agg(F.sum("w").alias("t"))
    return snapshot.join(total, "context").select("context", "shape", "n", _share(F.col("w"), F.col("t")).alias("share"))


def drift_events(drifts: DataFrame) -> DataFrame:
    """The contexts (context, psi) that have drifted."""
    return drifts.where("alert").select("context", "psi")


def predictability(shares: DataFrame) -> DataFrame:
    """(context, shape, confidence, observations, predictability): the likeliest shape, and 1 - H / ln k."""
    best = F.max_by("shape", F.struct(F.round("share", 12), F.col("shape")))
    h = -F.sum(F.when(F.col("share") > 0, F.col("share") * F.log("share")).otherwise(0.0))
    g = shares.groupBy("context").agg(best.alias("shape"), F.max("share").alias("confidence"), F.sum("n").cast("bigint").alias("observations"), F.count("*").alias("k"), h.alias("h"))
    return g.select("context", "shape", "confidence", "observations", F.when(F.col("k") <= 1, 1.0).otherwise(1 - F.col("h") / F.log(F.col("k"))).alias("predictability"))


def recent(obs: DataFrame, most: int = RECENT) -> DataFrame:
    w = Window.partitionBy("context").orderBy(F.desc("seq"))
    return obs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def drift(now: DataFrame, reference: DataFrame) -> DataFrame:
    """(context, psi, alert): population stability of two (context, shape, n) counts."""
    share = lambda d, c: d.groupBy("context", "shape").agg(F.sum("n").alias("n")).withColumn(c, F.col("n") / F.sum("n").over(Window.partitionBy("context"))).drop("n")
    both = share(now, "p").join(share(reference, "q"), ["context", "shape"], "full")
    p, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(EPSILON)) for c in ("p", "q"))
    out = both.groupBy("context").agg(F.sum((p - q) * F.log(p / q)).alias("psi"))
    return out.withColumn("alert", F.col("psi") > ALERT)


def speculation(predicted: DataFrame, drifts: DataFrame) -> DataFrame:
    """(context, actionable, reason)."""
    j = predicted.join(drifts, "context", "left").withColumn("psi", F.coalesce("psi", F.lit(0.0)))
    reason = (
        F.when(F.col("observations") < SEEN, "too few observations")
        .when(F.col("confidence") < SURE, "not sure enough")
        .when(F.col("psi") > ALERT, "drifting")
        .otherwise("ready")
    )
    return j.select("context", (reason == "ready").alias("actionable"), reason.alias("reason"))


def hits(obs: DataFrame) -> DataFrame:
    """(context, predictions, hits): how often the shape of the largest decayed weight before it was what came.

    Equal weights go to the larger name. Running weights of every shape of a
    context at every step, so use it on contexts with few shapes.
    """
    shapes = obs.select("context", F.col("shape").alias("other")).distinct()
    last = obs.agg(F.max("seq").alias("last"))
    weight = F.when(F.col("shape") == F.col("other"), F.exp((F.col("seq") - F.col("last")) * GROWTH)).otherwise(0.0)
    w = Window.partitionBy("context", "other").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    counts = obs.join(shapes, "context").crossJoin(last).withColumn("c", F.coalesce(F.sum(weight).over(w), F.lit(0.0)))
    at = counts.groupBy("context", "seq", "shape").agg(F.max(F.struct("c", "other")).alias("m"))
    known = at.where(F.col("m.c") > 0)
    return known.groupBy("context").agg(F.count("*").alias("predictions"), F.sum((F.col("m.other") == F.col("shape")).cast("int")).cast("bigint").alias("hits"))
