"""Vector functions over array columns, and the codes of scalar and binary quantisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """0 where the dimensions differ."""
    d = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    d = F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(float("inf")))


def manhattan(a: Column, b: Column) -> Column:
    d = _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(float("inf")))


def maxsim(query: Column, doc: Column) -> Column:
    """Sum over query tokens of the best dot product with any document token."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d))))
    return F.when((F.size(query) > 0) & (F.size(doc) > 0), _sum(best)).otherwise(F.lit(0.0))


def sq8(a: Column) -> Column:
    """struct(lo, step, codes): one byte a dimension between the least and the largest element."""
    lo, hi = F.array_min(a).cast("double"), F.array_max(a).cast("double")
    step = (hi - lo) / 255
    codes = F.transform(a, lambda x: F.when(step > 0, F.round((x.cast("double") - lo) / step)).otherwise(0).cast("int"))
    return F.struct(lo.alias("lo"), step.alias("step"), codes.alias("codes"))


def sq8_decode(code: Column) -> Column:
    return F.transform(code["codes"], lambda c: code["lo"] + c * code["step"])


def bq(a: Column) -> Column:
    """Sign bits as +1 / -1."""
    return F.transform(a, lambda x: F.when(x >= 0, 1).otherwise(-1))


def hamming(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda z: z))
