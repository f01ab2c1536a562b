"""Streams: ingestion through the gate, feed subscriptions, and a stateful baseline."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.operators import baseline, gate
from recollect.store import Store

DOCS = "id string, text string, metadata string, collection string"


def ingest(spark: SparkSession, store: Store, folder: str, checkpoint: str, files_per_batch: int = 16):
    """New JSON-line files of a folder go through the gate into the store, exactly as often as their content counts.

    Blocked documents are left out. The stream's checkpoint moves on only after
    a batch is published; a replayed batch upserts the same rows again.
    """
    rows = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", files_per_batch).json(folder)

    def put(batch: DataFrame, number: int) -> None:
        passed = batch.where(gate.verdict(F.col("text")) != "block").withColumn("pos", F.monotonically_increasing_id())
        if not passed.isEmpty():
            store.upsert(passed)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def subscribe(spark: SparkSession, feed_folder: str, since: int, each: Callable[[DataFrame, int], None], checkpoint: str):
    """Feed rows from ``since`` on, those there already first, then new ones as they are published."""
    feed = spark.readStream.schema("seq bigint, op string, doc_id string, at_ms bigint").option("recursiveFileLookup", True).parquet(feed_folder)
    return feed.where(F.col("seq") >= since).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def replicate(source: Store, target: Store, since: int, limit: int = 4096) -> int:
    """Applies a feed page to another store, last operation per document; returns the next cursor."""
    page = source.changes(since, limit)
    last = page.groupBy("doc_id").agg(F.max("seq").alias("seq")).withColumnRenamed("doc_id", "id")
    top = page.agg(F.max("seq")).first()[0]
    if top is None:
        return since
    now = last.join(source.docs(), "id").join(source.table("vecs"), "id", "left")
    if not now.isEmpty():
        target.upsert(now.drop("seq"))
    gone = last.join(source.docs().select("id"), "id", "left_anti").select("id")
    if not gone.isEmpty():
        target.remove(gone)
    return top + 1


def surprise(stream: DataFrame) -> DataFrame:
    """(context, seq, shape, predicted, hit) of a stream (context, seq, shape): what its context made most likely before it.

    Weights decay by the clock of ``seq`` as in the batch baseline. A shape whose
    weight has sunk below ``baseline.FORGOTTEN`` is dropped, so the state of a
    context is bounded by what it still remembers.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, held, last = state.get if state.exists else ([], [], None)
        weights = dict(zip(names, held))
        for p in parts:
            rows = []
            for seq, shape in p.sort_values("seq")[["seq", "shape"]].itertuples(index=False):
                if last is not None and seq > last:
                    fade = math.exp((last - seq) * baseline.GROWTH)
                    weights = {s: w * fade for s, w in weights.items() if w * fade >= baseline.FORGOTTEN}
                guess = max(weights, key=lambda s: (weights[s], s)) if weights else None
                rows.append((str(key[0]), seq, shape, guess, guess == shape))
                weights[shape] = weights.get(shape, 0.0) + 1.0
                last = seq if last is None else max(last, seq)
            yield pd.DataFrame(rows, columns=["context", "seq", "shape", "predicted", "hit"])
        state.update((list(weights), [float(w) for w in weights.values()], int(last or 0)))

    return stream.groupBy("context").applyInPandasWithState(
        step, "context string, seq bigint, shape string, predicted string, hit boolean", "shapes array<string>, weights array<double>, last bigint", "append", GroupStateTimeout.NoTimeout
    )


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n) of activity with no pause longer than ``gap``; timestamps are cast for the watermark."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    w = F.session_window("at", gap)
    return timed.groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
