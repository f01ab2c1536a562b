"""Table versions as pure functions: the new table from the old one and a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_of_batch(batch: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """Of rows with one key, the last by ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return batch.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert(old: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    return old.join(batch.select(key), key, "left_anti").unionByName(batch.select(*old.columns))


def remove(old: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return old.join(ids.select(key), key, "left_anti")


def apply_ops(old: DataFrame, ops: DataFrame, key: str = "id") -> DataFrame:
    """``ops`` (op upsert/remove, pos, columns of old): the last operation on each key decides."""
    last = last_of_batch(ops, key)
    return old.join(last.select(key), key, "left_anti").unionByName(last.where("op = 'upsert'").select(*old.columns))


def edit_metadata(old: DataFrame, ids: DataFrame, change) -> DataFrame:
    """``change``: a function of the map column, applied to the rows with the ids."""
    marked = old.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return marked.withColumn("metadata", F.when(F.col("__hit"), change(F.col("metadata"))).otherwise(F.col("metadata"))).select(*old.columns)


def set_keys(patch: dict[str, str]):
    p = F.create_map(*(F.lit(x) for kv in patch.items() for x in kv))
    return lambda m: F.map_concat(F.map_filter(m, lambda k, v: ~k.isin(*patch)), p)


def overwrite(patch: dict[str, str]):
    return lambda m: F.create_map(*(F.lit(x) for kv in patch.items() for x in kv))


def delete_keys(keys: list[str]):
    return lambda m: F.map_filter(m, lambda k, v: ~k.isin(*keys))


def clear():
    return lambda m: F.map_filter(m, lambda k, v: F.lit(False))


def feed_page(feed: DataFrame, since: int, limit: int) -> DataFrame:
    return feed.where(F.col("seq") >= since).orderBy("seq").limit(limit)


def replication(feed: DataFrame, docs: DataFrame) -> DataFrame:
    """Feed rows with the document as it is now; null where it is gone."""
    return feed.join(docs, feed["doc_id"] == docs["id"], "left")
