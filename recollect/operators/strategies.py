"""Searches built from searches: grouped, recommend, discover, matrix, facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import vectors as V
from recollect.operators import dense

POOL = 4


def grouped(hits: DataFrame, docs: DataFrame, by: str, groups: int, size: int) -> DataFrame:
    """(group_key, group_rank, hit_rank, id, score): the best hits of the best groups; documents without the field are passed over.

    ``hits`` is a bounded pool, so it goes to the documents.
    """
    keyed = docs.select("id", F.col(by).cast("string").alias("group_key")).join(F.broadcast(hits), "id").where("group_key is not null")
    inside = Window.partitionBy("group_key").orderBy("rank")
    best = keyed.withColumn("hit_rank", F.row_number().over(inside).cast("bigint")).withColumn("best", F.min("rank").over(Window.partitionBy("group_key"))).where(F.col("hit_rank") <= size)
    order = best.select("group_key", "best").distinct().orderBy("best").limit(groups)
    order = order.withColumn("group_rank", F.row_number().over(Window.orderBy("best")).cast("bigint")).drop("best")  # at most ``groups`` rows
    return best.join(order, "group_key").select("group_key", "group_rank", "hit_rank", "id", "score")


def recommend(vecs: DataFrame, positive: DataFrame, negative: DataFrame | None, k: int) -> DataFrame:
    """Nearest to the sum of the positives' unit vectors minus the negatives', without the examples.

    Unknown examples are passed over; without any known positive one it raises.
    """
    signed = positive.select("id", F.lit(1.0).alias("sign"))
    if negative is not None:
        signed = signed.unionByName(negative.select("id", F.lit(-1.0).alias("sign")))
    known = vecs.join(signed, "id")
    if known.where("sign > 0").isEmpty():
        raise LookupError("none of the positive examples is known")
    target = dense.centroid(known).first()["qvec"]
    return dense.search_one(vecs.join(signed.select("id"), "id", "left_anti"), tuple(target), k)


def discover(vecs: DataFrame, query: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The query's pool reordered by how often a document is nearer to ``pos`` than to ``neg``.

    ``pairs`` (pos, neg) are ids; a pair with an unknown id is passed over, a tie counts against.
    """
    pool = vecs.select("id", "vec").join(F.broadcast(dense.search(vecs, query, POOL * k).select("id", "score")), "id")
    p = vecs.select(F.col("id").alias("pos"), F.col("vec").alias("pv"))
    n = vecs.select(F.col("id").alias("neg"), F.col("vec").alias("nv"))
    known = pairs.join(p, "pos").join(n, "neg")
    vote = F.when(V.cosine(F.col("vec"), F.col("pv")) > V.cosine(F.col("vec"), F.col("nv")), 1).otherwise(-1)
    votes = pool.crossJoin(known).groupBy("id").agg(F.sum(vote).alias("agreement"))
    scored = pool.select("id", "score").join(votes, "id", "left").withColumn("agreement", F.coalesce("agreement", F.lit(0)).cast("bigint"))
    top = scored.orderBy(F.desc("agreement"), F.desc(F.round("score", 9)), "id").limit(k)
    w = Window.orderBy(F.desc("agreement"), F.desc(F.round("score", 9)), "id")  # at most k rows
    return top.withColumn("rank", F.row_number().over(w).cast("bigint"))


def similarity_matrix(vecs: DataFrame, ids: DataFrame) -> DataFrame:
    """(a, b, score) of every two listed ids (id, pos), in list order; unknown ids are passed over."""
    some = ids.join(vecs, "id")
    a = some.select(F.col("id").alias("a"), F.col("pos").alias("pa"), F.col("vec").alias("va"))
    b = some.select(F.col("id").alias("b"), F.col("pos").alias("pb"), F.col("vec").alias("vb"))
    return a.join(b, F.col("pa") < F.col("pb")).select("a", "b", V.cosine(F.col("va"), F.col("vb")).alias("score"))


def facet(docs: DataFrame, value) -> DataFrame:
    """(value, n); rows without the value are passed over."""
    return docs.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
