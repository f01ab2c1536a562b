"""Batch vector search: exact by blocks, by inverted cells, and by product codes with exact rescoring."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import dense
from recollect.operators.lexical import top

BLOCK, FETCH = 4096, 8
DENSE = 0.02  # share of open scores above which the whole product is cheaper than single rows


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _pick(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row of s by (score desc, id), scores at 9 digits."""
    v = np.round(s, 9)
    kth = np.partition(v, len(ids) - k, axis=1)[:, len(ids) - k]
    row, col = np.nonzero(v >= kth[:, None])  # all that tie at the k-th score, however many
    order = np.lexsort((ids[col], -v[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def best_of(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, bounds=None) -> pa.Table:
    """The k best rows of x for every row of q; ``bounds`` = (coarse rows, distances from them) spares exact scores that can't count."""
    out_q, out_i, out_s = [], [], []
    k = min(k, len(ids))
    for at in range(0, len(q), 512):
        part = q[at : at + 512]
        s = part @ x.T if bounds is None else bounded(part, x, *bounds, k)
        row, col = _pick(s, ids, k)
        out_q.append(qids[at : at + 512][row])
        out_i.append(ids[col])
        out_s.append(s[row, col])
    return pa.table([pa.array(np.concatenate(z)) for z in (out_q, out_i, out_s)], names=["query_id", "id", "score"])


def bounded(q: np.ndarray, x: np.ndarray, coarse: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """Exact q @ x.T wherever it can be among a row's k best, else -inf.

    A score differs from the coarse one by at most |x - coarse|, as queries have length 1, so a row
    whose upper bound stays under the k-th best lower bound is out; ties at 9 digits stay in.
    """
    s = q @ coarse.T
    floor = np.partition(s - off, len(x) - k, axis=1)[:, len(x) - k]
    open_ = s + off >= floor[:, None] - 2e-9
    if open_.mean() > DENSE:
        return np.where(open_, q @ x.T, -np.inf)
    s.fill(-np.inf)
    for i in range(len(q)):
        js = np.flatnonzero(open_[i])
        s[i, js] = x[js] @ q[i]
    return s


_HITS = "query_id bigint, id bigint, score double"


def _cross(k: int, book: "ProductCodes | None" = None):
    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "id", "score"])
        bounds = None
        if book is not None:
            codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(left.num_rows, -1)
            bounds = book.decode(codes), left.column("off").to_numpy()
        return best_of(left.column("id").to_numpy(), _matrix(left.column("vec")), right.column("query_id").to_numpy(), _matrix(right.column("qvec")), k, bounds)

    return run


def exact_batch(vecs: DataFrame, queries: DataFrame, k: int, n: int | None = None, book: "ProductCodes | None" = None) -> DataFrame:
    """The k best of all vectors for all queries: every block of vectors meets every block of queries once.

    With ``book``, ``vecs`` also has its ``codes`` and ``off``, the distance of each vector from its decoded codes.
    """
    blocks = max(1, math.ceil((n or vecs.count()) / BLOCK))
    qblocks = max(1, math.ceil(queries.count() / BLOCK))
    coded = [] if book is None else ["codes", "off"]
    v = vecs.select(F.col("id").cast("bigint").alias("id"), "vec", *coded, F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("vb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))
    q = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "qvec", F.pmod(F.xxhash64("query_id"), F.lit(qblocks)).alias("qb")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = q.withColumnsRenamed({"qb": "qb2", "vb": "vb2"})
    key = lambda a, b: (F.col(a) * F.lit(qblocks) + F.col(b)).cast("bigint")
    left = v.withColumn("cell", key("vb", "qb")).groupBy("cell")
    right = q.withColumn("cell2", key("vb2", "qb2")).groupBy("cell2")
    return top(left.cogroup(right).applyInArrow(_cross(k, book), _HITS), k)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        cell = np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)
        n = np.bincount(cell, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, cell, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def training_rows(vecs: DataFrame, most: int) -> np.ndarray:
    few = 2 * most / max(1, vecs.count())  # a hash bound first, so that a task hands in its share of the sample only
    some = vecs if few >= 1 else vecs.where(F.xxhash64("id") < int(-(2**63) + few * 2**64))
    rows = some.orderBy(F.xxhash64("id"), "id").limit(most).select("vec").toPandas()
    return np.stack(rows["vec"].map(np.asarray)).astype(float)


@dataclass
class Ivf:
    """Inverted cells: unit vectors assigned to k-means cells fitted on a bounded sample."""

    centroids: np.ndarray
    cells: DataFrame  # (id, vec, cell)
    probes: int = 8
    feed_seq: int = 0  # the store's sequence number when it was built; a later one makes the index stale

    @staticmethod
    def build(vecs: DataFrame, cells: int | None = None, sample: int = 20_000, feed_seq: int = 0, recall: float = 0.97) -> "Ivf":
        """The number of probes is the least that reaches ``recall`` at 10 on sampled queries within the sample."""
        x = training_rows(vecs, sample)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = kmeans(x, min(len(x), cells or max(1, math.isqrt(vecs.count()))))
        q = x[:256]
        true = np.argsort(-(q @ x.T), axis=1)[:, :10]
        far = (c * c).sum(axis=1)[None, :] - 2 * q @ c.T
        home = np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)
        place = np.argsort(np.argsort(far, axis=1), axis=1)  # rank of each cell for each query
        needed = np.sort(np.take_along_axis(place, home[true], axis=1).ravel()) + 1
        probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])
        return Ivf(c, Ivf._place(vecs, "id", "vec", c, 1), probes, feed_seq)

    @staticmethod
    def _place(df: DataFrame, id_: str, vec: str, c: np.ndarray, probes: int) -> DataFrame:
        p = min(probes, len(c))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = _matrix(b.column(1))
                d = (c * c).sum(axis=1) - 2 * x @ c.T
                near = np.argpartition(d, p - 1, axis=1)[:, :p]
                rows = pa.array(np.repeat(np.arange(len(x)), p))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(near.ravel().astype(np.int64))], names=[id_, vec, "cell"])

        kind, key = df.schema[vec].dataType.simpleString(), df.schema[id_].dataType.simpleString()
        return df.select(id_, vec).mapInArrow(run, f"{id_} {key}, {vec} {kind}, cell bigint")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank) from the ``probes`` nearest cells of each query."""
        probes = probes or self.probes
        q = self._place(queries, "query_id", "qvec", self.centroids, probes).withColumnRenamed("cell", "cell2")
        return top(self.cells.groupBy("cell").cogroup(q.groupBy("cell2")).applyInArrow(_cross(k), _HITS), k)


    def nearest(self, vector: tuple[float, ...]) -> list[int]:
        """The cells from the nearest to the farthest."""
        if len(vector) != self.centroids.shape[1]:
            raise ValueError(f"a query of {len(vector)} dimensions met vectors of {self.centroids.shape[1]}")
        q = np.asarray(vector, np.float64)
        q = q / (np.linalg.norm(q) or 1.0)
        return [int(c) for c in np.argsort((self.centroids**2).sum(axis=1) - 2 * self.centroids @ q, kind="stable")]

    def search_one(self, vector: tuple[float, ...], k: int, scope: DataFrame | None = None, probes: int | None = None) -> DataFrame:
        """(query_id 0, id, score, rank), scores exact. Cells are read by their number, which the stored table is sorted by.

        In a scope, cells are taken until they hold ``FETCH`` times k vectors of it, so a narrow one loses nothing.
        """
        order, probes = self.nearest(vector), probes or self.probes
        if scope is None:
            return dense.search_one(self.cells.where(F.col("cell").isin(order[:probes])), vector, k)
        members = self.cells.join(scope, "id", "left_semi")
        held = {r["cell"]: r["n"] for r in members.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
        taken, total = [], 0
        for c in (c for c in order if c in held):
            if len(taken) >= probes and total >= FETCH * k:
                break
            taken.append(c)
            total += held[c]
        return dense.search_one(members.where(F.col("cell").isin(taken)), vector, k)

    def insert(self, vecs: DataFrame, feed_seq: int) -> "Ivf":
        """With the vectors of ``vecs`` placed anew; those of equal ids go."""
        kept = self.cells.join(vecs.select("id"), "id", "left_anti")
        return Ivf(self.centroids, kept.unionByName(self._place(vecs, "id", "vec", self.centroids, 1)), self.probes, feed_seq)

    def remove(self, ids: DataFrame, feed_seq: int) -> "Ivf":
        return Ivf(self.centroids, self.cells.join(ids.select("id"), "id", "left_anti"), self.probes, feed_seq)

    def write(self, path: str) -> None:
        spark = self.cells.sparkSession
        self.cells.repartitionByRange("cell").sortWithinPartitions("cell").write.parquet(f"{path}/cells")
        rows = [(i, [float(x) for x in c], self.probes, self.feed_seq) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "cell bigint, vec array<double>, probes int, feed_seq bigint").coalesce(1).write.parquet(f"{path}/centroids")

    @staticmethod
    def read(spark: SparkSession, path: str) -> "Ivf":
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # a row a cell
        return Ivf(np.array([r["vec"] for r in rows]), spark.read.parquet(f"{path}/cells"), rows[0]["probes"], rows[0]["feed_seq"])


@dataclass
class ProductCodes:
    books: np.ndarray  # subspaces x codes x width

    @staticmethod
    def train(x: np.ndarray, subspaces: int = 16, codes: int = 256) -> "ProductCodes":
        parts = np.split(x, subspaces, axis=1)
        return ProductCodes(np.stack([np.resize(kmeans(p, min(codes, len(p))), (codes, p.shape[1])) for p in parts]))

    def encode(self, x: np.ndarray) -> np.ndarray:
        parts = np.split(x, len(self.books), axis=1)
        return np.stack([np.argmin((b * b).sum(axis=1) - 2 * p @ b.T, axis=1) for p, b in zip(parts, self.books)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[c] for b, c in zip(self.books, codes.T)], axis=1)


def pq_search(vecs: DataFrame, queries: DataFrame, k: int, sample: int = 4096) -> DataFrame:
    """The k best by exact cosine, of the rows that product codes leave open.

    Each vector carries its codes and its exact distance from them. That bounds every score from both sides,
    so the shortlist of a query is as long as it must be and the result exact, however near the vectors are.
    """
    x = training_rows(vecs, sample)
    book = ProductCodes.train(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = _matrix(b.column(1))
                codes = book.encode(rows)
                off = np.linalg.norm(rows - book.decode(codes), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)], names=["id", "vec", "codes", "off"])

    kind = vecs.schema["vec"].dataType.simpleString()
    coded = vecs.select(F.col("id").cast("bigint").alias("id"), "vec").mapInArrow(run, f"id bigint, vec {kind}, codes binary, off double")
    return exact_batch(coded, queries, k, vecs.count(), book)
