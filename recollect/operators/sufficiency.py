"""Whether the candidates cover the question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import content_tokens

READY, PARTIAL, LOOK_AT = 0.5, 0.25, 5


def coverage(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, ready, confidence, label) from (query_id, text) and candidates (query_id, id, rank, text).

    Confidence is the share of distinct query terms found in the first five
    candidates; lack of candidates is reported before lack of terms.
    """
    body = F.coalesce("text", F.lit(""))
    terms = queries.select("query_id", F.array_distinct(content_tokens(body)).alias("qt"))
    found = candidates.where(F.col("rank") <= LOOK_AT).groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(content_tokens(body)))).alias("ct"))
    j = terms.join(found, "query_id", "left")
    share = F.when(F.size("qt") > 0, F.size(F.array_intersect("qt", F.coalesce("ct", F.expr("cast(array() as array<string>)")))) / F.size("qt")).otherwise(F.lit(0.0))
    label = F.when(F.col("ct").isNull(), "no_context").when(F.size("qt") == 0, "empty_query").when(share >= READY, "ready").when(share >= PARTIAL, "partial").otherwise("insufficient")
    return j.select("query_id", (label == "ready").alias("ready"), share.alias("confidence"), label.alias("label"))
