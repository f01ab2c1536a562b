"""Near-duplicate embeddings: spherical k-means, blocked products, one kept.

Equal vectors are collapsed first, so copies cost nothing further on.
Centroids are fitted on all distinct vectors: each round assigns every vector
to its most similar centroid and renormalises the sums, which tasks hand in
added up and packed by blocks of cells. The number of cells is the square root
of the number of vectors, so both the centroid table and the cells stay small
as the data grows.

A vector is compared in its ``PROBES`` nearest cells (recall of near
pairs against brute force is tested to be 0.9 and more; in practice above 0.99). A cell's vectors are split into blocks,
and every pair of blocks is one product of two matrices; a hot cell is many
blocks, not one long task. A product keeps a spanning forest of its near pairs, so
thousands of near copies cost thousands of edges. Groups are the connected
components; the least id represents its group.

Result: (vec_id, group_id, keep). Defined results: rows with a null id are
left out; a null, empty or zero vector, one with a null or non-finite element, or one of
another dimension than the most frequent, resembles nothing and is kept as its own group.
Repeated rows (equal ids) are one vector, the least by content. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.components import components, forest
from recollect.llm.memory import tidy
from recollect.runtime import cut

THRESHOLD, PROBES, ROUNDS, BLOCK, SEED, CELLS_A_BLOCK = 0.95, 3, 4, 2048, 5, 512


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(-1, dim)


def unit_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the usable vectors, normalised, and their dimension."""
    e = F.col("e")
    good = F.coalesce(~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e18)), F.lit(False))
    base = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<float>").alias("e")).where(good & (F.size("e") > 0))
    dims = base.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return base.select("vec_id", F.col("e").alias("v")), 0
    norm = F.sqrt(F.aggregate("e", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))
    one = base.where(F.size("e") == dims["d"]).groupBy("vec_id").agg(F.min("e").alias("e")).withColumn("norm", norm).where("norm > 0")
    return one.select("vec_id", F.transform("e", lambda x: (x / F.col("norm")).cast("float")).alias("v")), dims["d"]


def _added(dim: int):
    """Adds up the sums of one block of cells, as matrices."""

    def run(table: pa.Table) -> pa.Table:
        sums = np.zeros((CELLS_A_BLOCK, dim))
        used = np.zeros(CELLS_A_BLOCK, bool)
        block = table.column("block")[0].as_py()
        rows = [(np.frombuffer(c.as_py(), np.int32) - block, s) for c, s in zip(table.column("cells"), table.column("s"))]
        for cells, s in sorted(rows, key=lambda r: r[1].as_py()):  # in one order, so that a sum is always the same
            sums[cells] += np.frombuffer(s.as_py()).reshape(-1, dim)
            used[cells] = True
        at = np.flatnonzero(used)
        return pa.table({"block": [block], "cells": [(block + at).astype(np.int32).tobytes()], "s": [sums[at].tobytes()]}, schema=pa.schema([("block", pa.int64()), ("cells", pa.binary()), ("s", pa.binary())]))

    return run


def fit(units: DataFrame, dim: int, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centroids by spherical Lloyd rounds over all vectors."""
    rows = units.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(k).select("v").toPandas()
    centre = np.stack(rows["v"].map(np.asarray)).astype(np.float32)
    for _ in range(rounds):
        now = centre

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((len(now), dim)), np.zeros(len(now), np.int64)
            for b in batches:
                x = _matrix(b.column(0), dim)
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096]
                    cell = np.argmax(part @ now.T, axis=1)
                    np.add.at(sums, cell, part)
                    counts += np.bincount(cell, minlength=len(now))
            for block in range(0, len(now), CELLS_A_BLOCK):
                used = block + np.flatnonzero(counts[block : block + CELLS_A_BLOCK])
                if len(used):
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([used.astype(np.int32).tobytes()]), pa.array([sums[used].tobytes()])], names=["block", "cells", "s"])

        parts = units.select("v").mapInArrow(tidy(run), "block bigint, cells binary, s binary")
        new = centre.copy()
        for r in parts.groupBy("block").applyInArrow(_added(dim), "block bigint, cells binary, s binary").collect():  # a row a block of centroids
            cells, s = np.frombuffer(r["cells"], np.int32), np.frombuffer(r["s"]).reshape(-1, dim)
            norm = np.linalg.norm(s, axis=1)
            new[cells[norm > 0]] = (s[norm > 0] / norm[norm > 0, None]).astype(np.float32)
        if np.abs(new - centre).max() < 1e-4:
            break
        centre = new
    return centre


def assign(units: DataFrame, dim: int, centre: np.ndarray, probes: int = PROBES) -> DataFrame:
    """(vec_id, v, cell): every vector once for each of its nearest cells."""
    p = min(probes, len(centre))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            if not len(x):
                continue
            near = np.concatenate([np.argpartition(-(x[at : at + 4096] @ centre.T), p - 1, axis=1)[:, :p] for at in range(0, len(x), 4096)])
            rows = pa.array(np.repeat(np.arange(len(x)), p))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(near.ravel().astype(np.int64))], names=["vec_id", "v", "cell"])

    return units.select("vec_id", "v").mapInArrow(tidy(run), "vec_id bigint, v array<float>, cell bigint")


def _compare(threshold: float):
    def run(key, table):
        ids = table.column("vec_id").to_numpy()
        side = table.column("block").to_numpy()
        x = np.asarray(table.column("v").combine_chunks().flatten()).astype(np.float32).reshape(len(ids), -1)
        lo, hi = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        found_a, found_b = [], []
        for at in range(0, len(left), 1024):
            rows = left[at : at + 1024]
            i, j = np.nonzero(x[rows] @ x[right].T >= threshold)
            keep = ids[rows[i]] != ids[right[j]]
            found_a.append(rows[i][keep])
            found_b.append(right[j][keep])
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (found_a, found_b))
        node, root = forest(ids, a, b)
        return pa.table([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["a", "b"])

    return run


def near_pairs(units: DataFrame, dim: int, threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """(a, b): edges that connect all near vectors that share a probed cell."""
    n = units.count()
    centre = fit(units, dim, max(1, math.isqrt(n)))
    placed = cut(assign(units, dim, centre, probes))
    load = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    split = placed.join(load, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    other = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = other.select("cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "vec_id", "v")
    return pairs.groupBy("cell", "lo", "hi").applyInArrow(_compare(threshold), "a bigint, b bigint")


def dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """(vec_id, group_id, keep) of every distinct id."""
    units, dim = unit_vectors(vectors, vec_id, embedding)
    everything = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("bigint").alias("vec_id")).distinct()
    if not dim:
        return everything.select("vec_id", F.col("vec_id").alias("group_id"), F.lit(True).alias("keep"))
    units = cut(units)
    # copies of a vector meet through its least id
    first = units.groupBy("v").agg(F.min("vec_id").alias("first"))
    distinct = cut(first.select(F.col("first").alias("vec_id"), "v"))
    copies = units.join(first, "v").where("vec_id <> first").select(F.col("vec_id").alias("a"), F.col("first").alias("b"))
    groups = components(near_pairs(distinct, dim, threshold, probes).unionByName(copies), "a", "b").where("node <> root")
    joined = everything.join(groups, F.col("vec_id") == F.col("node"), "left")
    return joined.select("vec_id", F.coalesce("root", "vec_id").alias("group_id"), F.col("root").isNull().alias("keep"))
