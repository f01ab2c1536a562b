"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length. Each source gets a
token budget; the counts are first scaled down alike at every length, then the
remaining budget is filled: lengths with the largest remainders first, and at
the end a bounded knapsack over the lengths still available, by dynamic
programming, so that the budget is met to the token wherever a subset sum
allows it. Which documents of a length are taken is decided by a seeded hash.

Targets: ``weights`` by source, or by default tokens ** ``alpha``, normalised.
A source with less than its share gives all it has, and the others share what
it lacks by their weights; none repeats. With ``budget`` the total is the
budget, or all tokens if there are fewer. Without, the default weights are
scaled so that a source of mean size (the mean over tokens, sum(t * t) /
sum(t)) gives exactly all it has: smaller ones are kept whole, larger ones cut
to t ** alpha * mean ** (1 - alpha). However sizes are spread, that leaves at
least 85 % of all tokens at alpha 1/2, and 75 % at any alpha from 0 to 1, and
no small source can lower it. ``weights`` of the caller without a budget are
kept exactly, so there the source that runs out first ends the mix.

Which documents of a length are taken is decided within slices of the hash's
range, of about ``ROWS_A_SLICE`` rows: only the slice in which the count is
reached is ranked, so a length or source that most documents have is no task
of its own.

Defined results: a null source is the source ''. Rows with a null ``doc_id``
are left out of ``select`` (they cannot be chosen by name) but not of
``keep_mix``; documents without tokens are left out of both. Rows that repeat
an id and a text count and stay once; rows that share an id but not a text are
several. Ties of the hash go by ``doc_id``. A source without a weight gets
none. Above ``KNAPSACK`` tokens the remaining budget is filled by the longest
lengths that fit; dynamic programming fills the rest to the token. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import rows, tokens
from recollect.runtime import cut

ALPHA, SEED, KNAPSACK, ROWS_A_SLICE = 0.5, 23, 1 << 16, 200_000


def knapsack(lengths: np.ndarray, available: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum is as large as possible within the budget."""
    take = np.zeros(len(lengths), np.int64)
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    by = np.full(budget + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        n, length = int(min(available[i], budget // lengths[i] if lengths[i] else 0)), int(lengths[i])
        k = 1
        while n > 0 and not reach[budget]:
            k = min(k, n)
            n -= k
            size = k * length
            fresh = np.flatnonzero(~reach[size:] & reach[: budget + 1 - size]) + size
            by[fresh] = len(items)
            reach[fresh] = True
            items.append((int(i), k))
            k *= 2
        if reach[budget]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, k = items[by[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length make up the budget (at most, and exactly where possible)."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros(len(counts), np.int64)
    share = counts * (budget / total)
    take = np.minimum(np.floor(share + 1e-9).astype(np.int64), counts)
    left = budget - int((lengths * take).sum())
    while left < 0:  # only by rounding
        i = int(np.argmax(np.where(take > 0, lengths, -1)))
        take[i] -= 1
        left += int(lengths[i])
    room = counts - take
    for i in np.lexsort((lengths, -(share - np.floor(share)))):
        if left <= KNAPSACK:
            break
        if room[i] > 0 and lengths[i] <= left:
            take[i] += 1
            room[i] -= 1
            left -= int(lengths[i])
    while left > KNAPSACK:
        fits = np.flatnonzero((room > 0) & (lengths <= left))
        if not len(fits):
            break
        i = fits[np.argmax(lengths[fits])]
        n = int(min(room[i], max(1, (left - KNAPSACK) // lengths[i])))
        take[i] += n
        room[i] -= n
        left -= n * int(lengths[i])
    return take + knapsack(lengths, room, min(left, KNAPSACK))


def budgets(totals: dict[str, int], weights: dict[str, float] | None, alpha: float, budget: int | None) -> dict[str, int]:
    weight = {s: (t**alpha if weights is None else weights.get(s, 0.0)) for s, t in totals.items() if t > 0}
    norm = sum(weight.values())
    if norm <= 0:
        return {}
    weight = {s: w / norm for s, w in weight.items() if w > 0}
    if budget is not None:
        level = fill({s: totals[s] for s in weight}, weight, budget)
    elif weights is not None:
        level = min(totals[s] / w for s, w in weight.items())
    else:
        mean = sum(totals[s] ** 2 for s in weight) / sum(totals[s] for s in weight)
        level = norm * mean ** (1 - alpha)
    return {s: min(totals[s], int(w * level + 1e-6)) for s, w in weight.items()}


def fill(totals: dict[str, int], weight: dict[str, float], budget: int) -> float:
    """The level at which min(tokens, weight * level) over all sources adds up to the budget."""
    left, rest = max(0, budget), sum(weight.values())
    for s in sorted(weight, key=lambda s: totals[s] / weight[s]):
        level = totals[s] / weight[s]
        if rest * level >= left:
            return left / rest
        left, rest = left - totals[s], max(rest - weight[s], weight[s] * 1e-12)
    return max(totals[s] / w for s, w in weight.items()) + 1


def select(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, weights: dict[str, float] | None = None, alpha: float = ALPHA, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents chosen."""
    chosen = _select(docs.where(F.col("doc_id").isNotNull()), vocabulary, weights, alpha, budget, seed)
    return chosen.select(F.col("id").alias("doc_id"), "source", "n_tokens")


def _select(docs: DataFrame, vocabulary: str, weights: dict[str, float] | None, alpha: float, budget: int | None, seed: int) -> DataFrame:
    """(id, h, source, n_tokens) of the rows chosen."""
    one, two = rows.identity()
    named = docs.select(one.alias("id"), two.alias("h"), F.coalesce("source", F.lit("")).alias("source"), "text")
    counted = cut(tokens.with_counts(named, vocabulary).where("n_tokens > 0").groupBy("id", "h", "n_tokens").agg(F.min("source").alias("source")))
    return select_counted(counted, weights, alpha, budget, seed, "id", "h")


def select_counted(counted: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, budget: int | None = None, seed: int = SEED, *key: str) -> DataFrame:
    """The chosen rows of ``counted`` (key columns, by default doc_id, then source and n_tokens)."""
    key = key or ("doc_id",)
    lengths = cut(counted.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    totals = lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).cast("bigint").alias("t"), F.max("n").alias("most")).collect()  # a row a source
    targets = budgets({r["source"]: r["t"] for r in totals}, weights, alpha, budget)
    bits = max(0, (max((r["most"] for r in totals), default=0) // ROWS_A_SLICE).bit_length())

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        k = fit(pdf["n_tokens"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), targets.get(pdf["source"].iloc[0], 0))
        return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "k": k})

    chosen = lengths.groupBy("source").applyInPandas(take, "source string, n_tokens bigint, k bigint").where("k > 0")
    draw = tokens.seeded(seed, *key)
    sliced = counted.withColumn("draw", draw).withColumn("slice", F.shiftright("draw", 64 - bits) if bits else F.lit(0).cast("bigint"))
    by = ["source", "n_tokens", "slice"]
    so_far = Window.partitionBy("source", "n_tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** bits rows
    rest = F.col("k") - F.coalesce(F.sum("n").over(so_far), F.lit(0))
    slices = sliced.groupBy(*by).agg(F.count("*").alias("n")).join(chosen, ["source", "n_tokens"]).withColumn("rest", rest).where("rest > 0")
    met = sliced.join(slices.select(*by, "rest", "n"), by)
    order = Window.partitionBy(*by).orderBy("draw", *key)
    ranked = met.where("rest < n").withColumn("r", F.row_number().over(order)).where("r <= rest")
    names = [*key, "source", "n_tokens"]
    return met.where("rest >= n").select(*names).unionByName(ranked.select(*names))


def keep_mix(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, weights: dict[str, float] | None = None, alpha: float = ALPHA, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """The chosen rows with all columns of ``docs``."""
    return rows.only(docs, _select(docs, vocabulary, weights, alpha, budget, seed))
