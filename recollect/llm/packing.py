"""Best-fit packing of documents into sequences of a fixed token length.

Lengths are rounded up to units. Every way to fill a sequence exactly with up
to three pieces is a pattern; non-negative least squares fits how often each
pattern must repeat to use up the histogram of lengths. Repeat counts are
rounded and never exceed what the histogram holds; what remains is packed by
best fit on the histogram, largest piece first. The plan has at most a few
thousand lines whatever the number of documents, because it only depends on
the histogram; documents find their place by their rank within their length.

A document longer than a sequence is cut into pieces of the full length and a
rest. Result: one row a piece (doc_id, piece, start, n_tokens, pack_id, slot).

Defined results: a document without tokens (null or empty text) keeps one row
with null ``pack_id``. Rows with a null ``doc_id`` and repeated rows are packed
like any other. Ties in rank go by (hash, doc_id, piece). An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import tokens
from recollect.runtime import cut

LENGTH, UNIT, BUCKETS, MOST_BUCKETS, ROWS_A_BUCKET, SEED = 2048, 8, 64, 1024, 500_000, 17


@lru_cache(maxsize=4)
def patterns(units: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, with a + b + c = units."""
    rows = [(units, 0, 0)]
    rows += [(a, units - a, 0) for a in range((units + 1) // 2, units)]
    for a in range(1, units - 1):
        for b in range(1, min(a, units - a - 1) + 1):
            c = units - a - b
            if 1 <= c <= b:
                rows.append((a, b, c))
    return np.array(rows)


def design(units: int) -> np.ndarray:
    p = patterns(units)
    a = np.zeros((units, len(p)))
    for column in p.T:
        used = np.flatnonzero(column)
        np.add.at(a, (column[used] - 1, used), 1.0)
    return a


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1200, tol: float = 1e-6) -> np.ndarray:
    """argmin |a x - b| over x >= 0 (active set method of Lawson and Hanson)."""
    x, barred = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    passive: list[int] = []
    w = a.T @ b
    scale = max(1e-30, float(np.abs(w).max()))

    def solve() -> np.ndarray:
        part = a[:, passive]
        gram = part.T @ part
        return np.linalg.solve(gram + 1e-12 * np.eye(len(passive)), part.T @ b)

    for _ in range(rounds):
        w[passive] = -np.inf
        w[barred] = -np.inf
        j = int(np.argmax(w))
        if len(passive) >= a.shape[0] or w[j] <= tol * scale:
            break
        passive.append(j)
        z = solve()
        if z[-1] <= 0:  # it cannot enter at this point
            passive.pop()
            barred[j] = True
            continue
        barred[:] = False
        while passive and z.min() <= 0:
            old = x[passive]
            low = z <= 0
            step = np.min(old[low] / (old[low] - z[low]))
            old = old + step * (z - old)
            old[low & (old <= 1e-14)] = 0.0
            if not (low & (old == 0.0)).any():
                old[int(np.argmin(np.where(low, old, np.inf)))] = 0.0
            x[passive] = old
            passive = [p for p, v in zip(passive, old) if v > 0]
            z = solve() if passive else np.zeros(0)
        x[passive] = z
        w = a.T @ (b - a @ x)
    return x


def plan(histogram: dict[int, int], units: int) -> list[tuple[dict[int, int], int]]:
    """[(pieces by length in units, number of sequences)], using every piece of the histogram once."""
    left = np.zeros(units + 1, np.int64)
    for size, n in histogram.items():
        left[size] += n
    result: list[tuple[dict[int, int], int]] = []
    total = int(left[1:].sum())
    if not total:
        return result
    p = patterns(units)
    x = nnls(design(units), left[1:] / total)
    times = np.rint(x * total).astype(np.int64)
    for j in np.lexsort((np.arange(len(x)), -times)):
        if times[j] <= 0:
            break
        parts: dict[int, int] = {}
        for v in p[j]:
            if v:
                parts[int(v)] = parts.get(int(v), 0) + 1
        n = min([int(times[j]), *(int(left[v]) // m for v, m in parts.items())])
        if n > 0:
            result.append((parts, n))
            for v, m in parts.items():
                left[v] -= n * m
    while True:
        held = np.flatnonzero(left)
        if not len(held):
            return result
        room, parts = units, {}
        while True:
            fit = held[held <= room]
            fit = [int(v) for v in fit[::-1] if left[v] > parts.get(int(v), 0)]
            if not fit:
                break
            v = fit[0]
            parts[v] = parts.get(v, 0) + 1
            room -= v
        n = min(int(left[v]) // m for v, m in parts.items())
        result.append((parts, n))
        for v, m in parts.items():
            left[v] -= n * m


def intervals(packs: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(units, first rank, end rank, first pack, pieces a pack, first slot) of every line of the plan."""
    rows, at, base = [], {}, 0
    for parts, n in packs:
        slot = 0
        for size in sorted(parts, reverse=True):
            m, start = parts[size], at.get(size, 0)
            rows.append((size, start, start + n * m, base, m, slot))
            at[size] = start + n * m
            slot += m
        base += n
    return rows


def pieces(counted: DataFrame, length: int, unit: int) -> DataFrame:
    """(doc_id, piece, start, n_tokens, units) from (doc_id, n_tokens)."""
    whole = F.floor(F.col("total") / length).cast("int")
    last = F.greatest(F.lit(0), F.ceil(F.col("total") / length).cast("int") - 1)
    return (
        counted.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("total"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
        .select(
            "doc_id",
            F.col("piece").cast("bigint").alias("piece"),
            (F.col("piece").cast("bigint") * length).alias("start"),
            F.when(F.col("piece") < whole, F.lit(length).cast("bigint")).otherwise(F.col("total") - F.col("piece").cast("bigint") * length).alias("n_tokens"),
        )
        .withColumn("units", F.ceil(F.col("n_tokens") / unit).cast("int"))
    )


def pack_lengths(counted: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """Packs (doc_id, n_tokens)."""
    if length % unit:
        raise ValueError("the length must be a multiple of the unit")
    spark = counted.sparkSession
    key = tokens.seeded(SEED, "doc_id", "piece")
    made = cut(pieces(counted, length, unit).withColumn("h", key))
    # the order is that of the hash, however many buckets its range has
    bits = min(MOST_BUCKETS, max(BUCKETS, made.count() // ROWS_A_BUCKET)).bit_length() - 1
    all_pieces = made.withColumn("bucket", F.shiftright("h", 64 - bits).cast("int"))
    counts = all_pieces.where("units > 0").groupBy("units", "bucket").agg(F.count("*").alias("n"))
    held = counts.collect()  # at most length / unit x MOST_BUCKETS rows
    histogram: dict[int, int] = {}
    for r in held:
        histogram[r["units"]] = histogram.get(r["units"], 0) + r["n"]
    before, offsets = {}, []
    for r in sorted(held, key=lambda r: (r["units"], r["bucket"])):
        offsets.append((r["units"], r["bucket"], before.get(r["units"], 0)))
        before[r["units"]] = before.get(r["units"], 0) + r["n"]
    lines = intervals(plan(histogram, length // unit))
    # both tables are bounded by length, unit and MOST_BUCKETS, not by the data
    offset = F.broadcast(spark.createDataFrame(offsets, "units int, bucket int, before bigint"))
    line = F.broadcast(spark.createDataFrame(lines, "units int, lo bigint, hi bigint, base bigint, m bigint, first_slot bigint"))
    inside = Window.partitionBy("units", "bucket").orderBy("h", "doc_id", "piece")
    ranked = (
        all_pieces.where("units > 0")
        .withColumn("r", F.row_number().over(inside) - 1)
        .join(offset, ["units", "bucket"])
        .withColumn("r", F.col("r") + F.col("before"))
        .join(line, "units")
        .where("r >= lo and r < hi")
        .select(
            "doc_id",
            "piece",
            "start",
            "n_tokens",
            (F.col("base") + F.floor((F.col("r") - F.col("lo")) / F.col("m"))).cast("bigint").alias("pack_id"),
            (F.col("first_slot") + (F.col("r") - F.col("lo")) % F.col("m")).cast("bigint").alias("slot"),
        )
    )
    none = F.lit(None).cast("bigint")
    empty = all_pieces.where("units = 0").select("doc_id", "piece", "start", "n_tokens", none.alias("pack_id"), none.alias("slot"))
    return ranked.unionByName(empty)


def pack(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    return pack_lengths(tokens.with_counts(docs.select("doc_id", "text"), vocabulary), length, unit)
