"""Quality by hierarchical empirical Bayes.

A logistic classifier over a document's own form (Catalyst expressions only)
gives the document evidence; it is fitted on a bounded sample of labelled
documents (at most ``SAMPLE`` rows, the lowest by hash). Every host (``source``) and every path below it (here
the language section of the host) gets a Beta posterior of the share of good
documents: path counts shrink toward their host, host counts toward the global
mean. Both strengths are fitted by the method of moments: that of the global
prior to the spread between hosts, that of a host to the spread between the
paths of hosts. A document's own evidence is left out of the posteriors that
judge it. Document odds are then moved by how far the posterior of its path
lies from the global mean, with weight ``SITE_WEIGHT``.

The text is read once; the evidence is kept as a narrow table. Site counts are
grouped aggregates that meet the documents by joins on the site, which Spark
broadcasts only below its own threshold.

Result: (doc_id, source, lang, doc_prob, host_mean, path_mean, score, keep).
Defined results: null or empty texts are documents without words; a null source or lang is
the site ''. Without usable labels (none, or of one class) the classifier is the prior
share and the score follows the sites alone. Repeated rows count each time. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm import quality_rules
from recollect.runtime import cut

SAMPLE, SITE_WEIGHT, MOST_STRENGTH, CUTOFF, RIDGE = 20_000, 0.5, 1e4, 0.5, 1e-2
EASE = 20
FEATURES = ("log_words", *(m for m in quality_rules.METRICS if m != "n_words"))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, features): the narrow table of evidence."""
    base = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    scored = quality_rules.score(base).withColumn("log_words", F.log1p("n_words"))
    squash = lambda c: F.least(F.col(c), F.lit(20.0)).cast("double")
    # a few words say little of their stop words: start from the usual share
    eased = scored.withColumn("stop_ratio", (F.col("stop_ratio") * F.col("n_words") + 0.3 * EASE) / (F.col("n_words") + EASE))
    return eased.select("doc_id", "source", "lang", F.array(*(squash(c) for c in FEATURES)).alias("x"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 40) -> np.ndarray:
    """Weights with the intercept first, by damped Newton steps."""
    a = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.diag([1e-6, *([ridge * len(x)] * x.shape[1])])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(evidence: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, scales); weights are zero where labels can't tell."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("y"))
    labelled = evidence.join(known, "doc_id").select("doc_id", "x", "y")
    # a hash bound lets about twice the sample through, so a task hands in its share and not a sample of its own
    few = 2 * sample / max(1, known.count())
    labelled = labelled if few >= 1 else labelled.where(F.xxhash64("doc_id") < int(-(2**63) + few * 2**64))
    rows = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
    d = len(FEATURES)
    if rows.empty or rows["y"].nunique() < 2:
        share = 0.5 if rows.empty else float(np.clip(rows["y"].mean(), 0.02, 0.98))
        return np.array([np.log(share / (1 - share)), *([0.0] * d)]), np.zeros(d), np.ones(d)
    x, y = np.stack(rows["x"].map(np.asarray)), rows["y"].to_numpy(float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    return fit_logistic((x - mean) / scale, y), mean, scale


def probability(weights: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> Column:
    z = F.lit(float(weights[0]))
    for i in range(len(FEATURES)):
        z = z + F.lit(float(weights[i + 1] / scale[i])) * (F.get("x", F.lit(i)) - F.lit(float(mean[i])))
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))))


def strength(within: float, between: float) -> float:
    """Pseudo-counts of a prior: how many documents say as much as the prior does."""
    return float(np.clip(within / between if between > 0 else MOST_STRENGTH, 1.0, MOST_STRENGTH))


def strengths(n: float, s: float, q: float, paths: tuple[float, float, float], hosts: tuple[float, float, float]) -> tuple[float, float]:
    """(strength of the global prior, strength of a host) by the method of moments.

    ``n``, ``s``, ``q``: documents, sum and sum of squares of their evidence;
    ``paths``: (number of paths, sum of s * s / n over them, sum of n * n / host's n);
    ``hosts``: (number of hosts, sum of s * s / n over them, sum of n * n).
    """
    (np_, bp, up), (nh, bh, n2) = paths, hosts
    noise = max(1e-9, (q - bp) / max(1.0, n - np_))  # of documents within a path
    unit = (n - up) / max(1.0, np_ - nh)
    path = strength(noise, ((bp - bh) / max(1.0, np_ - nh) - noise) / max(unit, 1e-9) if np_ > nh else 0.0)
    within = max(1e-9, (q - bh) / max(1.0, n - nh))  # of documents within a host
    unit = (n - n2 / n) / max(1.0, nh - 1)
    host = strength(within, ((bh - s * s / n) / max(1.0, nh - 1) - within) / max(unit, 1e-9) if nh > 1 else 0.0)
    return host, path


def site_sums(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """((source, lang, n, s, hn, hs), global mean, host strength, path strength) from (source, lang, doc_prob)."""
    paths = cut(scored.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("doc_prob").alias("s"), F.sum(F.col("doc_prob") * F.col("doc_prob")).alias("q")))
    hosts = paths.groupBy("source").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    sites = cut(paths.join(hosts, "source"))
    p = sites.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n") * F.col("n") / F.col("hn")).alias("u")).first()
    if not p["n"]:
        return sites, 0.5, 1.0, 1.0
    h = hosts.agg(F.count("*").alias("k"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("b"), F.sum(F.col("hn") * F.col("hn")).alias("n2")).first()
    host, path = strengths(p["n"], p["s"], p["q"], (p["k"], p["b"], p["u"]), (h["k"], h["b"], h["n2"]))
    return sites, p["s"] / p["n"], host, path


def posteriors(mu: float, host: float, path: float, own: Column | None = None) -> tuple[Column, Column]:
    """(host mean, path mean) of columns n, s, hn, hs, without the evidence ``own`` of one document."""
    one, x = (F.lit(0), F.lit(0.0)) if own is None else (F.lit(1), own)
    host_mean = (F.col("hs") - x + F.lit(host * mu)) / (F.col("hn") - one + F.lit(host))
    return host_mean, (F.col("s") - x + F.lit(path) * host_mean) / (F.col("n") - one + F.lit(path))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """((source, lang, host_mean, path_mean), global mean) from (source, lang, doc_prob)."""
    sites, mu, host, path = site_sums(scored)
    host_mean, path_mean = posteriors(mu, host, path)
    return sites.select("source", "lang", host_mean.alias("host_mean"), path_mean.alias("path_mean")), mu


def logit(p: Column) -> Column:
    held = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(held / (1 - held))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, site_weight: float = SITE_WEIGHT, cutoff: float = CUTOFF) -> DataFrame:
    evidence = cut(features(docs))
    scored = evidence.withColumn("doc_prob", probability(*fit(evidence, labels, sample))).drop("x")
    sites, mu, host, path = site_sums(scored)
    host_mean, path_mean = posteriors(mu, host, path, F.col("doc_prob"))
    out = scored.join(sites, ["source", "lang"]).withColumns({"host_mean": host_mean, "path_mean": path_mean})
    z = logit(F.col("doc_prob")) + F.lit(site_weight) * (logit(F.col("path_mean")) - logit(F.lit(mu)))
    out = out.withColumn("score", 1 / (1 + F.exp(-z)))
    rounded = [F.round(c, 6).alias(c) for c in ("doc_prob", "host_mean", "path_mean", "score")]
    return out.select("doc_id", "source", "lang", *rounded, (F.col("score") >= cutoff).alias("keep"))
