"""Exact vector search: one query or many, one space or several."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import vectors as V
from recollect.operators.lexical import best, top


def search(vecs: DataFrame, queries: DataFrame, k: int, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k most similar by cosine.

    ``vecs`` (id, vec), ``queries`` (query_id, qvec). Norms are taken once per
    vector and once per query; the rank filter runs before the shuffle.
    """
    if scope is not None:
        vecs = vecs.join(scope, "id", "left_semi")
    left = vecs.withColumn("n", V.norm(F.col("vec")))
    right = queries.withColumn("qn", V.norm(F.col("qvec")))
    n = F.col("n") * F.col("qn")
    score = F.when(n > 0, V.dot(F.col("vec"), F.col("qvec")) / n).otherwise(F.lit(0.0))
    scored = left.crossJoin(right).select("query_id", "id", score.alias("score"))
    return top(scored, k)


def search_one(vecs: DataFrame, vector: tuple[float, ...], k: int, scope: DataFrame | None = None) -> DataFrame:
    """``search`` for one query that the caller has in hand: matrix products over Arrow batches, k rows from each.

    A vector of another dimension raises, as does a query without elements.
    """
    if not len(vector):
        raise ValueError("a query vector needs elements")
    if scope is not None:
        vecs = vecs.join(scope, "id", "left_semi")
    q = np.asarray(vector, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.compute.is_valid(b.column(1)))
            if not b.num_rows:
                continue
            size = pa.compute.list_value_length(b.column(1))
            if pa.compute.any(pa.compute.not_equal(size, len(q))).as_py():
                raise ValueError(f"a query of {len(q)} dimensions met a vector of another dimension")
            x = np.asarray(b.column(1).flatten()).astype(np.float64).reshape(b.num_rows, -1)
            n = np.linalg.norm(x, axis=1)
            s = np.divide(x @ q, n, out=np.zeros(len(x)), where=n > 0)
            at = np.arange(len(s))
            if k < len(s):
                kth = np.partition(np.round(s, 9), len(s) - k)[len(s) - k]
                at = np.flatnonzero(np.round(s, 9) >= kth)  # all that tie at the k-th score
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(s[at])], names=["id", "score"])

    kind = vecs.schema["id"].dataType.simpleString()
    scored = vecs.select("id", "vec").mapInArrow(run, f"id {kind}, score double")
    return best(scored.select(F.lit(0).alias("query_id"), "id", "score"), k)


def maxsim(pool: DataFrame, tokens: DataFrame, query_tokens) -> DataFrame:
    """``pool`` (id, rank, ...) with ``maxsim`` and its new order: scored documents first, the others after as before.

    ``tokens`` (id, vecs): a document's token vectors.
    """
    joined = pool.join(tokens, "id", "left").withColumn("maxsim", F.when(F.col("vecs").isNotNull(), V.maxsim(query_tokens, F.col("vecs"))))
    return joined.drop("vecs")


def sparse_search(sparse: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """``sparse`` (id, dim, weight) against ``query`` (query_id, dim, qweight): the k largest dot products."""
    s = sparse.join(query, "dim").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("qweight")).alias("score"))
    return top(s, k)


def centroid(vecs: DataFrame, sign: str = "sign") -> DataFrame:
    """One row (qvec): the normalised sum of signed unit vectors (vec, sign)."""
    unit = vecs.select(F.posexplode(V.normalize(F.col("vec"))).alias("pos", "x"), F.col(sign).alias("s"))
    parts = unit.groupBy("pos").agg(F.sum(F.col("x") * F.col("s")).alias("x"))
    row = parts.agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return row.where(F.size("v") > 0).select(V.normalize(F.transform("v", lambda e: e["x"])).alias("qvec"))
